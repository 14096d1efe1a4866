"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

Words are runs of 0-9, A-Z (lower-cased), a-z and every character beyond ASCII. One pass over the texts stores the index: a posting (term, document,
position) for each occurrence of a term that some phrase has, and one that ends each document. Term counts are taken from it, and every search reads it alone.

Phrases. The terms of a phrase are ranked, rarest first. The list of the rarest, each posting moved back by the term's offset in the phrase, gives places where the phrase
may start; they are intersected with the list of the second by its offset, and what is left with the lists of all others. Lists of frequent terms are
so read only for documents that hold the rarest ones. Phrases with a term that the corpus lacks are dropped at once.
Proximity. An occurrence of the rarest term is a match if every other term of the phrase stands within some places of it, in any order: the same lists, intersected by
steps of positions in place of single ones.

Documents are told apart by doc_id and a hash of the text, so rows that repeat an id with another text are judged by themselves.

Defined results: null and empty texts have no words; an item without words has no window; repeated rows get the same result each; a null doc_id is a value like others; a null item_id counts as an
item but its id is left out of the list; empty tables give no hits; other columns are passed by, whatever their names. Very long texts are one row until their words are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import delete, fresh, written

WINDOW = 10
#: Phrase tables up to this many words are broadcast; beyond it they are joined by a shuffle on the term.
BROADCAST_WORDS = 4_000_000
#: Places looked up are broadcast up to this number (some 200 bytes each); beyond it both sides are shuffled.
BROADCAST_PLACES = 100_000
#: How far other terms may stand from the rarest one in a proximity match.
WITHIN = 9
#: What tells documents apart; a null doc_id has a hash of its own.
KEY = ["id", "h"]
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text. ``lower`` is right for ASCII texts only; others have A-Z replaced letter by letter."""
    low = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, NOT_WORD), "")


def phrases(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, pid, phrase): the distinct windows of each item; an item of fewer words is one window. pid: a number for each distinct phrase."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("phrase")).distinct()
    for salt in range(10):
        out = each.withColumn("pid", F.xxhash64("phrase", F.lit(salt)))
        phrase, pid = out.agg(F.count_distinct(F.array_join("phrase", " ")), F.count_distinct("pid")).first()
        if phrase == pid:
            return out
    raise RuntimeError("phrases cannot be numbered")


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, id, h, words) of the documents."""
    id_ = F.col("doc_id").cast("long")
    return documents.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-1)).alias("id"), F.xxhash64("text", id_.isNull()).alias("h"), words_of(F.coalesce("text", F.lit(""))).alias("words"))


def index_of(documents: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """(term, doc_id, id, h, position): the postings of the given terms, and for each document one of the empty term at its end."""
    ended = terms.select("term").unionByName(documents.sparkSession.range(1).select(F.lit("").alias("term")))
    at = keyed(documents).select("doc_id", *KEY, F.posexplode(F.concat("words", F.array(F.lit("")))).alias("position", "term"))
    if small:
        return at.join(F.broadcast(ended), "term")
    again = F.xxhash64("term")  # a second key lets Spark deal both sides out anew and split hot terms
    return at.withColumn("again", again).join(ended.withColumn("again", again), ["term", "again"]).drop("again")


def ranked(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(pid, n, offset, term, rank): the terms of each phrase, rarest in the index first; none for a phrase with a term that never occurs."""
    counts = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("times"))
    each = wanted.select("pid", "phrase").distinct().select("pid", F.size("phrase").alias("n"), F.posexplode("phrase").alias("offset", "term"))
    each = each.join(counts, "term", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    whole = Window.partitionBy("pid")
    each = each.withColumn("least", F.min("times").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy("times", "offset")))
    return each.where("least > 0").select("pid", "n", "offset", "term", "rank")


def _looked_up(index: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``wanted`` whose place (``on``) is in the index. Few of them are broadcast; for many, only the lists of their terms are read, or only their documents, and both sides are shuffled."""
    wanted = written(wanted, "decontam-places")
    if wanted.count() <= BROADCAST_PLACES:
        return index.join(F.broadcast(wanted), on)
    for keys in (["term"], KEY):
        some = written(wanted.select(*keys).distinct(), "decontam-wanted")
        index = index.join(F.broadcast(some) if some.count() <= BROADCAST_PLACES else some, keys, "left_semi")
    return index.join(wanted, on)


def rarest(index: DataFrame, lists: DataFrame, small: bool) -> DataFrame:
    """(id, h, pid, n, at, lead): the postings of each phrase's rarest term, and its offset in the phrase."""
    first = lists.where("rank = 1").select("pid", "n", "term", F.col("offset").alias("lead"))
    found = index.join(F.broadcast(first) if small else first, "term")
    return written(found.select(*KEY, "pid", "n", F.col("position").alias("at"), "lead").distinct(), "decontam-rarest")


def phrase_matches(index: DataFrame, lists: DataFrame, places: DataFrame) -> DataFrame:
    """(id, h, pid, n, start): exact occurrences, by intersecting the lists of the phrase's terms, each moved back by its offset."""
    postings = index.select("term", *KEY, "position")
    on = ["term", *KEY, "position"]
    starts = places.select(*KEY, "pid", "n", (F.col("at") - F.col("lead")).alias("start")).where("start >= 0")
    term = lists.select("pid", "offset", "term", "rank")
    moved = lambda rows, some: rows.join(some, "pid").withColumn("position", (F.col("start") + F.col("offset")).cast("int"))
    two = _looked_up(postings, moved(starts.where("n > 1"), term.where("rank = 2")), on).select(*starts.columns).distinct()
    two = written(two, "decontam-second")
    rest = _looked_up(postings, moved(two.where("n > 2"), term.where("rank > 2")), on).select(*starts.columns, "offset").distinct()
    whole = rest.groupBy(*starts.columns).agg(F.count("*").alias("found")).where("found = n - 2").select(*starts.columns)
    return starts.where("n = 1").unionByName(two.where("n = 2")).unionByName(whole)


def proximity_matches(index: DataFrame, lists: DataFrame, places: DataFrame, within: int = WITHIN) -> DataFrame:
    """(id, h, pid, at): occurrences of a phrase's rarest term that have all its other terms within ``within`` places, in any order."""
    step = within + 1
    postings = index.select("term", *KEY, F.floor(F.col("position") / step).cast("int").alias("step"), "position")
    on = ["term", *KEY, "step"]
    # each other term once, the rarest first
    first = lists.where("rank = 1").select("pid", F.col("term").alias("lead_term"))
    others = lists.join(first, "pid").where("term <> lead_term").groupBy("pid", "term").agg(F.min("rank").alias("rank"))
    whole = Window.partitionBy("pid")
    others = others.withColumn("others", F.count("*").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy("rank"))).select("pid", "term", "rank", "others")
    others = written(others, "decontam-others")

    def near(rows: DataFrame, some: DataFrame) -> DataFrame:
        here = F.floor(F.col("at") / step).cast("int")
        wanted = rows.join(some, "pid").withColumn("step", F.explode(F.array(here - 1, here, here + 1)))
        return _looked_up(postings, wanted, on).where(F.abs(F.col("position") - F.col("at")) <= within)

    spots = places.select(*KEY, "pid", "at")
    alone = spots.join(others.select("pid").distinct(), "pid", "left_anti")
    second = written(near(spots, others.where("rank = 1")).select(*KEY, "pid", "at", "others").distinct(), "decontam-near")
    rest = near(second.where("others > 1").drop("others"), others.where("rank > 1")).select(*KEY, "pid", "at", "others", "term").distinct()
    every = rest.groupBy(*KEY, "pid", "at", "others").agg(F.count("*").alias("found")).where("found = others - 1").select(*KEY, "pid", "at")
    return alone.select(*KEY, "pid", "at").unionByName(second.where("others = 1").select(*KEY, "pid", "at")).unionByName(every)


def search(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(index, phrases, lists, places): the stored index and what searches start from."""
    wanted = written(phrases(benchmark, n), "decontam-phrases")
    small = wanted.agg(F.coalesce(F.sum(F.size("phrase")), F.lit(0))).first()[0] <= BROADCAST_WORDS
    index = written(index_of(documents, wanted.select(F.explode("phrase").alias("term")).distinct(), small), "decontam-index")
    lists = written(ranked(wanted, index), "decontam-lists")
    return index, wanted, lists, rarest(index, lists, small)


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, within: int | None = None) -> DataFrame:
    """Every document's n_words, n_hit, n_items, items (ids as sorted strings) and, with ``within``, n_near (items with a proximity match)."""
    index, wanted, lists, places = search(documents, benchmark, n)
    items = wanted.select("pid", "item_id")
    hits = written(phrase_matches(index, lists, places), "decontam-hits")
    spans = hits.groupBy(*KEY, "start").agg(F.max("n").alias("len"))
    order = Window.partitionBy(*KEY).orderBy("start")
    end = F.col("start") + F.col("len")
    reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.select(*KEY, F.greatest(end - F.greatest("start", reached), F.lit(0)).alias("new")).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    found = hits.select(*KEY, "pid").distinct().join(items, "pid").select(*KEY, "item_id").distinct()
    found = found.groupBy(*KEY).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    out = index.where("term = ''").select("doc_id", *KEY, F.col("position").cast("long").alias("n_words"))
    out = out.join(covered.join(found, KEY), KEY, "left")
    columns = ["doc_id", "n_words", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")], F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    if within is not None:
        near = proximity_matches(index, lists, places, within).select(*KEY, "pid").distinct().join(items, "pid").select(*KEY, "item_id").distinct()
        out = out.join(written(near.groupBy(*KEY).agg(F.count("*").alias("n_near")), "decontam-near-items"), KEY, "left")
        columns.append(F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    return out.select(*columns)


def clean(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, without a word inside a benchmark window."""
    index, _, lists, places = search(documents, benchmark, n)
    hit_id, hit_h = fresh(documents, "hit_id", "hit_h")
    found = phrase_matches(index, lists, places).select(F.col("id").alias(hit_id), F.col("h").alias(hit_h)).distinct()
    found = written(found, "decontam-hit-documents")  # its size is known when the join is planned: no shuffle of the texts while it is small
    delete(index, lists, places)
    id_ = F.col("doc_id").cast("long")
    here = (F.coalesce(id_, F.lit(-1)) == F.col(hit_id)) & (F.xxhash64("text", id_.isNull()) == F.col(hit_h))
    return documents.join(found, here, "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, and the items whose windows it nearly holds."""
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(documents, benchmark, within=WITHIN)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS phrase, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM p),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, p.item_id, dw.s, dw.n FROM dw JOIN p ON dw.phrase = p.phrase AND dw.n = p.n),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
times AS (SELECT term, count(*) AS n FROM word GROUP BY term),
part AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS term, unnest(range(0, n)) AS place FROM (SELECT DISTINCT phrase, n FROM p)),
led AS (SELECT phrase, arg_min(part.term, (coalesce(times.n, 0), place)) AS term, count(DISTINCT part.term) AS terms FROM part LEFT JOIN times ON part.term = times.term GROUP BY phrase HAVING min(coalesce(times.n, 0)) > 0),
spot AS (SELECT doc_id, phrase, pos, terms FROM led JOIN word ON word.term = led.term),
near AS (SELECT spot.doc_id, spot.phrase, spot.pos, any_value(spot.terms) AS terms, count(DISTINCT word.term) AS found FROM spot JOIN part ON part.phrase = spot.phrase JOIN word ON word.doc_id = spot.doc_id AND word.term = part.term AND abs(word.pos - spot.pos) <= 9 GROUP BY spot.doc_id, spot.phrase, spot.pos),
n_near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN p ON near.phrase = p.phrase WHERE found = terms GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN n_near USING (doc_id)
"""
