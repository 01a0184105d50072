"""Operator 7 [native]: benchmark decontamination by size-partitioned MinHash containment search.

The texts are hashed word shingles: of five words, or of all its words for an item that has fewer;
documents are cut into shingles of each size that some item has. One pass over the documents keeps
those of their hashes that occur in some item. Items are put into partitions by the power of two
that bounds their number of shingles; of each item the k lowest hashes are its sketch, where k
follows from the partition's bound u: k = floor((1 - threshold) * u) + 1, or all if it has fewer.
Lowest is by how many documents have the hash, then by the hash itself: passages that everybody
shares come last, so they make no candidates. A text that contains the threshold's share of an item
lacks at most floor((1 - threshold) * n) of its n shingles, so it has one of the sketch at least,
however long it is and however hashes are ordered: the search loses nothing. Pairs that share a
sketch hash are verified by the exact share of the item's shingles in the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgrid.llm.common import WORD, written

WORDS, THRESHOLD = 5, 0.8
#: Hashes up to which what is made of the items is broadcast (about 64 MB); beyond it Spark shuffles.
BROADCAST_ROWS = 2_000_000


def shingles(*sizes: str | int) -> str:
    """SQL for the hashes of all shingles of these numbers of words (or SQL for them, of the words w) of the column text, lower-cased.

    The words are bound as a lambda's argument, so that they are extracted once for a text. Explode
    it directly: of a named column Spark would infer a filter and evaluate it twice.
    """

    def of(k: str | int) -> str:
        if isinstance(k, str):
            return f"transform(sequence(1, size(v) - {k} + 1), i -> aggregate(slice(v, i, {k}), 0L, (a, x) -> xxhash64(a, x)))"
        args = ", ".join(["x", *(f"v[i + {n}]" for n in range(1, k))])
        folded = "0L"
        for x in args.split(", "):
            folded = f"xxhash64({folded}, {x})"
        return f"CASE WHEN size(v) >= {k} THEN transform(slice(v, 1, size(v) - {k - 1}), (x, i) -> {folded}) ELSE array() END"

    all_ = of(sizes[0]) if len(sizes) == 1 else f"concat({', '.join(map(of, sizes))})"
    return f"transform(array(transform(regexp_extract_all(lower(text), r'{WORD}', 0), x -> xxhash64(x))), v -> {all_})[0]"


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than limit rows."""
    return F.broadcast(df) if df.count() <= limit else df


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs of a document and an item of which it has the threshold's share of shingles at least.

    docs: doc_id, text; benchmark: item_id, text (other columns are not read). An item of fewer than
    `words` words is one shingle, so a document contains it if it has those words in a row. Null
    texts and texts without a word are in no pair. Of repeated rows with the same ids a pair is
    returned once, with the highest containment; a null id stays null.
    Returns doc_id, item_id, n_item, n_shared, containment, and h_doc, a hash of the document's text.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("item_id", "text").alias("item"), F.expr(f"size(regexp_extract_all(lower(text), r'{WORD}', 0))").alias("n_words")).where("n_words > 0")
    items = items.select("item_id", "item", F.least("n_words", F.lit(words)).alias("size"), F.expr(f"array_distinct({shingles(f'least({words}, size(v))')})").alias("sh"))
    items = written(items.dropDuplicates(["item"]).withColumn("n_item", F.size("sh")), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # no more than `words` numbers
    total = items.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]

    def given(df: DataFrame) -> DataFrame:  # none of what is made of the items has more hashes than they
        return F.broadcast(df) if total <= broadcast_rows else df

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h_doc")).where("text IS NOT NULL")
    hashes = rows.select("doc_id", "h_doc", F.explode(F.expr(shingles(*(sizes or [words])))).alias("h"))
    each = items.select("item", "n_item", F.explode("sh").alias("h"))
    # written, as it is read several times and takes a scan of all shingles
    hits = written(hashes.join(given(each.select("h").distinct()), "h", "left_semi").distinct(), "hits")

    bound = F.pow(F.lit(2), F.ceil(F.log2("n_item")))
    # the small number keeps (1 - threshold) * bound from falling just under a whole number
    k = F.least("n_item", F.floor((1 - threshold) * bound + 1e-9) + 1).cast("int")
    known = each.join(hits.groupBy("h").agg(F.count("*").alias("n")), "h", "left").groupBy("item", "n_item").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h"))).alias("s"))
    sketch = known.select("item", F.explode(F.slice("s", F.lit(1), k)).alias("s")).where("s.n > 0").select("item", "s.h")
    candidates = written(hits.join(given(sketch), "h").select("doc_id", "h_doc", "item").distinct(), "candidates")

    pairs = candidates.select("h_doc", "item").distinct()
    own = hits.join(small(pairs.select("h_doc").distinct(), broadcast_rows), "h_doc", "left_semi").groupBy("h_doc").agg(F.collect_set("h").alias("hs"))
    pairs = pairs.join(own, "h_doc").join(given(items.select("item", "item_id", "n_item", "sh")), "item")
    pairs = pairs.select("h_doc", "item", "item_id", "n_item", F.size(F.array_intersect("hs", "sh")).cast("long").alias("n_shared")).where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    pairs = candidates.join(pairs, ["h_doc", "item"])
    best = F.max_by(F.struct("n_item", "n_shared", "h_doc"), F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "h_doc"))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_shared").alias("n_shared"), F.round(F.col("b.n_shared") / F.col("b.n_item"), 6).alias("containment"), F.col("b.h_doc").alias("h_doc"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """h_doc (xxhash64 of the text) of the documents that contain an item."""
    return contained(docs, benchmark, threshold).select("h_doc").distinct()


ORACLE = r"""
WITH dw AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
bk AS (SELECT *, least(5, len(w)) AS k FROM bw WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, text, list_slice(w, i, i + k - 1) AS g FROM dw CROSS JOIN (SELECT DISTINCT k FROM bk), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
b AS (SELECT DISTINCT item_id, text, list_slice(w, i, i + k - 1) AS g FROM bk, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
n AS (SELECT item_id, text, count(*) AS n_item FROM b GROUP BY ALL),
p AS (SELECT d.doc_id, b.item_id, d.text, n_item, count(*) AS n_shared FROM d JOIN b USING (g) JOIN n ON n.item_id = b.item_id AND n.text = b.text GROUP BY d.doc_id, d.text, b.item_id, b.text, n_item)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM p WHERE n_shared >= 0.8 * n_item - 1e-9
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_shared / n_item DESC, n_item DESC) = 1
"""
