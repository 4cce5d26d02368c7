"""Benchmark decontamination by a distributed positional inverted index.

The benchmark's items are cut into windows of consecutive words. The training
texts are read and cut into words once: the postings (term, document, position)
of every word that the benchmark knows are stored as the index, in segments
ordered by term, each document's number of words beside them. All that follows
reads the index alone. Terms are counted in it; each window is led by its rarest
terms. A posting less the term's offset in the window is where the window would
start, and the offset-adjusted lists of the leading terms are intersected. What
remains is verified against the postings of every other term of the window in
those documents. With ``slop`` 0 the matches are exact phrases; with a greater
slop every term but the rarest may stand so many words off its place (proximity
matches).

DataFrame functions only. Windows whose terms do not all occur are dropped at
once. Test vocabulary and windows are broadcast only if they are few and short
(``BROADCAST_TERMS``, ``BROADCAST_BYTES``); beyond that the joins shuffle. The
index is thinned before verification by at most ``BUCKETS`` numbers of document
buckets. No step pairs documents; a term's postings are combined by document and
start, so a hot term is spread.

Null texts have no words. Items of fewer words than a window, but not none, are
one window; items without words never occur. Rows are told apart by id and
text, so that repeated rows get equal results and a null id is an id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rivulet.llm.common import fold_ascii, scratch, stored

WINDOW = 13
#: What words are not made of, once A-Z are folded.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms (or offsets of windows) up to which a side is broadcast, and bytes of
#: all terms: some 100 bytes each beside their own.
BROADCAST_TERMS, BROADCAST_BYTES = 400_000, 32 << 20
#: Buckets of documents by which the index is thinned: numbers broadcast at most.
BUCKETS = 1 << 20
#: Terms whose lists are intersected before all others are verified.
LEADING = 2
#: Words that a term may stand off its place in the query's proximity matches.
SLOP = 1
#: Windows are verified by one bit for each offset.
LONGEST_WINDOW = 60
#: The index' entry of a document itself: a term that no word is, at the position
#: after the last word.
_DOCUMENT = -1


def words(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(items: DataFrame, length: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(window_id, size, offset, term) of the distinct windows, and (window_id, item_id)."""
    if not 1 <= length <= LONGEST_WINDOW:
        raise ValueError(f"a window has 1 to {LONGEST_WINDOW} words")
    own = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(length))
    cut = own.select("item", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"), size.alias("size"), "w").select("item", F.slice("w", F.col("at"), F.col("size")).alias("terms"))
    distinct = stored(cut.select("terms").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    of_item = stored(cut.join(distinct, "terms").select("window_id", "item").distinct(), "window_items")
    return distinct.select("window_id", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")), of_item


def _small(df: DataFrame, n: int, size: int = 0) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_TERMS and size <= BROADCAST_BYTES else df


def _row_key(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull())


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(text_col, F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and two longs that tell rows apart."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _row_key(id_col).alias("k1"), _text_key(text_col).alias("k2"))


@dataclass
class Index:
    """Postings (tid, k1, k2, pos, doc_id) of the benchmark's terms in the training
    texts, and the windows by numbered terms: (window_id, size, offset, tid, term)."""

    postings: DataFrame
    terms: DataFrame
    of_item: DataFrame
    n_terms: int
    n_offsets: int

    def documents(self) -> DataFrame:
        """doc_id, k1, k2, n_words: a row for each row indexed."""
        return self.postings.where(F.col("tid") == _DOCUMENT).select("doc_id", "k1", "k2", F.col("pos").cast("long").alias("n_words"))


def build_index(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> Index:
    """The index of ``keyed`` documents; the one place that reads their texts."""
    terms, of_item = windows(items, length)
    vocabulary = stored(terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    n_terms, n_bytes = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    spark = docs.sparkSession
    known = vocabulary.unionByName(spark.createDataFrame([("", _DOCUMENT)], vocabulary.schema))
    each = docs.select("doc_id", "k1", "k2", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "term"))
    found = each.join(_small(known, n_terms, n_bytes), "term")
    segments = found.select("tid", "k1", "k2", "pos", F.when(F.col("tid") == _DOCUMENT, F.col("doc_id")).alias("doc_id")).sortWithinPartitions("tid")
    numbered = stored(terms.join(_small(vocabulary, n_terms, n_bytes), "term"), "window_terms")
    return Index(stored(segments, "postings"), numbered, of_item, n_terms, numbered.count())


def matches(docs: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Where windows occur in ``keyed`` documents: (k1, k2, window_id, start,
    size, exact), and the (window_id, item) table. ``exact`` tells a phrase from
    a proximity match, whose window may reach ``slop`` words beyond the text."""
    index = build_index(docs, items, length)
    return occurrences(index, slop), index.of_item


def occurrences(index: Index, slop: int = 0) -> DataFrame:
    """The first table of ``matches``, from the index alone."""
    postings = index.postings.where(F.col("tid") != _DOCUMENT).select("tid", "k1", "k2", "pos")
    counts = stored(postings.groupBy("tid").agg(F.count("*").alias("tf")), "term_counts")
    ranked = (
        index.terms.join(_small(counts, index.n_terms), "tid")
        .withColumn("rank", F.row_number().over(W.partitionBy("window_id").orderBy("tf", "term", "offset")))
        .withColumn("found", F.count("*").over(W.partitionBy("window_id")))
        .where("found = size")
        .select("window_id", "size", "offset", "tid", "rank")
    )
    ranked = stored(ranked, "ranked_windows")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c)
    about = F.sequence(F.lit(-slop), F.lit(slop))
    # the rarest term stands at its place, the second by so many words off it
    lead = ranked.where(F.col("rank") <= LEADING).withColumn("off", F.explode(F.when(F.col("rank") == 1, F.array(F.lit(0))).otherwise(about)))
    begun = (
        postings.join(_small(lead, index.n_offsets), "tid")
        .select("k1", "k2", "window_id", "size", (F.col("pos") - F.col("offset") - F.col("off")).alias("start"), bit(F.col("offset")).alias("bit"), (F.col("off") == 0).alias("here"))
        .where(F.col("start") >= -slop)  # words off their place may come before the window's start
        .groupBy("k1", "k2", "window_id", "size", "start")
        .agg(F.bit_or("bit").alias("bits"), F.bit_or(F.when(F.col("here"), F.col("bit")).otherwise(0)).alias("exact"))
        .where(F.bit_count("bits") == F.least(F.col("size"), F.lit(LEADING)))
    )
    begun = stored(begun, "candidates")
    whole = begun.where(F.bit_count("bits") == F.col("size"))
    rest = begun.where(F.bit_count("bits") < F.col("size"))
    others = ranked.where(F.col("rank") > LEADING).select("window_id", "offset", "tid", F.explode(about).alias("off"))
    expected = rest.join(_small(others, index.n_offsets), "window_id").withColumn("pos", F.col("start") + F.col("offset") + F.col("off"))
    bucket = F.pmod(F.col("k1"), F.lit(BUCKETS)).alias("bucket")
    there = postings.withColumn("bucket", bucket).join(F.broadcast(rest.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    proved = (
        expected.join(there, ["k1", "k2", "pos", "tid"])
        .groupBy("k1", "k2", "window_id", "size", "start")
        .agg(F.bit_or(F.col("bits").bitwiseOR(bit(F.col("offset")))).alias("bits"), F.bit_or(F.when(F.col("off") == 0, F.col("exact").bitwiseOR(bit(F.col("offset")))).otherwise(0)).alias("exact"))
        .where(F.bit_count("bits") == F.col("size"))
    )
    return whole.unionByName(proved).select("k1", "k2", "window_id", "start", "size", (F.bit_count("exact") == F.col("size")).alias("exact"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW, slop: int = 0) -> DataFrame:
    """A row for each document: doc_id, k1, k2, n_words; ``n_hit``, words inside
    matches; ``items``, the ids, as sorted strings, of items with matches (at
    most as many as the benchmark has); ``n_exact`` and ``exact_items``, the
    same of exact phrases alone; ``longest``, the words of the longest phrase."""
    with scratch(docs.sparkSession):
        index = build_index(keyed(docs, id_col, text_col), items, length)
        found, key = stored(occurrences(index, slop), "matches"), ["k1", "k2"]
        first, last, placed = F.col("start"), F.col("start") + F.col("size") - 1, found
        if slop:  # within the text
            placed = found.join(index.documents().select("k1", "k2", F.col("n_words").alias("n")).distinct(), key)
            first, last = F.greatest(first, F.lit(0)), F.least(last, F.col("n").cast("int") - 1)
        places = placed.select("k1", "k2", "exact", F.explode(F.sequence(first, last)).alias("pos")).groupBy("k1", "k2", "pos").agg(F.max("exact").alias("exact"))
        hit = places.groupBy(*key).agg(F.count("*").alias("n_hit"), F.count_if("exact").alias("n_exact"))
        named = found.groupBy("k1", "k2", "window_id").agg(F.max("exact").alias("exact"), F.max(F.when(F.col("exact"), F.col("size")).otherwise(0)).alias("longest")).join(index.of_item, "window_id")
        named = named.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("exact_items"), F.max("longest").alias("longest"))
        none, no_items = F.lit(0).cast("long"), F.array().cast("array<string>")
        told = index.documents().join(hit.join(named, key), key, "left")
        return stored(told.select("doc_id", "k1", "k2", "n_words", *(F.coalesce(c, none).alias(c) for c in ("n_hit", "n_exact")), *(F.coalesce(c, no_items).alias(c) for c in ("items", "exact_items")), F.coalesce("longest", F.lit(0)).alias("longest")), "contamination", lasting=True)


def contaminated() -> Column:
    """At least a twentieth of the words are in exact phrases."""
    return (F.col("n_exact") > 0) & (20 * F.col("n_exact") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", any_window: bool = False, length: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (any columns) that are not contaminated. With
    ``any_window`` a row also goes if it has one phrase of ``length`` words, its
    share of the text whatever; shorter items still count by their share."""
    goes = contaminated() | (F.col("longest") >= length) if any_window else contaminated()
    bad = contamination(docs, items, id_col, text_col, length).where(goes).select("k1", "k2").distinct()
    keys = [F.col("k1").alias("_rv_k1"), F.col("k2").alias("_rv_k2")]
    bad = bad.select(*keys, F.pmod("k1", F.lit(BUCKETS)).alias("_rv_bucket"))
    own = docs.withColumns({"_rv_k1": _row_key(id_col), "_rv_k2": _text_key(text_col)}).withColumn("_rv_bucket", F.pmod("_rv_k1", F.lit(BUCKETS)))
    # only rows that share a bucket with a bad one are shuffled, with their texts
    buckets = F.broadcast(bad.select("_rv_bucket").distinct())
    far = own.join(buckets, "_rv_bucket", "left_anti")
    near = own.join(buckets, "_rv_bucket", "left_semi").join(bad.drop("_rv_bucket"), ["_rv_k1", "_rv_k2"], "left_anti")
    return far.unionByName(near).drop("_rv_k1", "_rv_k2", "_rv_bucket")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's rows. Beside the exact phrases ``n_near`` and ``n_near_items``
    count words in, and items with, phrases or proximity matches of slop ``SLOP``."""
    return contamination(docs, items, slop=SLOP).select(
        "doc_id",
        "n_words",
        F.col("n_exact").alias("n_hit"),
        F.size("exact_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("exact_items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.col("n_hit").alias("n_near"),
        F.size("items").cast("long").alias("n_near_items"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win
       FROM (SELECT item, w, least(13, len(w)) AS size, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS p
             FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, item, dw.size AS size, p FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS pos FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1),
win AS (SELECT DISTINCT win, string_split(win, ' ') AS t FROM bw),
wt AS (SELECT win, len(t) AS size, unnest(generate_series(0, len(t) - 1)) AS o, unnest(t) AS term FROM win),
dp AS (SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS p, unnest(w) AS term FROM d WHERE len(w) > 0),
tf AS (SELECT term, count(*) AS c FROM dp WHERE term IN (SELECT term FROM wt) GROUP BY 1),
anchor AS (SELECT win, size, o, wt.term FROM wt JOIN tf USING (term) QUALIFY row_number() OVER (PARTITION BY win ORDER BY c, wt.term, o) = 1),
begun AS (SELECT DISTINCT dp.doc_id, win, size, p - o AS b FROM dp JOIN anchor USING (term) WHERE p - o >= -1),
near AS (SELECT x.doc_id, x.win, x.size AS size, b, len(w) AS n
         FROM begun x JOIN d ON d.doc_id = x.doc_id JOIN win ON win.win = x.win JOIN anchor a ON a.win = x.win
         WHERE len(list_filter(generate_series(0, x.size - 1), lambda k: t[k + 1] = w[b + k + 1]
                   OR k <> a.o AND (b + k >= 1 AND t[k + 1] = w[b + k] OR b + k + 2 >= 1 AND t[k + 1] = w[b + k + 2]))) = x.size),
nhit AS (SELECT doc_id, count(DISTINCT pos) AS n_near FROM (SELECT doc_id, unnest(generate_series(greatest(b, 0), least(b + size, n) - 1)) AS pos FROM near) GROUP BY 1),
nits AS (SELECT doc_id, count(DISTINCT item) AS n_near_items FROM near JOIN bw ON bw.win = near.win GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nhit USING (doc_id) LEFT JOIN nits USING (doc_id)
"""
