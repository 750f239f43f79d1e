"""I-Match document fingerprints over randomised lexicons, in DataFrame functions only.

Terms are the distinct lower-case words of a text. The lexicon holds the terms whose document frequency lies in
a band: not in more than ``most`` of all documents, and not in less than ``least``. Rarer and commoner terms say
little about likeness. A lexicon subset keeps each term with a probability of 1, 1/2, 1/4, ..., several times
each, by a hash of the term. A document's fingerprint has one hash for each subset, of the sorted terms it has
there; likeness is the share of equal ones among the subsets that either document has terms in.

The lexicon is bounded: a text has d distinct terms on average, so at most d / least terms can reach the lower end
of the band, whatever the size of the corpus. It is broadcast behind a check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandmill.storage import materialize

LEAST, MOST = 0.001, 0.2
SCALES, SUBSETS = 9, 8
#: Hex digits of a subset's hash in the fingerprint.
DIGITS = 6
SPACE = r"[\x20\x09-\x0D]+"
#: A lexicon of at most as many terms is broadcast; a larger one is joined by a shuffle.
BROADCAST_TERMS = 2_000_000
#: A block of neighbours has 2^FAN_BITS consecutive ids.
FAN_BITS = 8


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-case words."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(documents: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(term) of the band, from the document frequencies over all documents."""
    total = documents.count()
    seen = documents.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return seen.where((F.col("df") >= max(2, least * total)) & (F.col("df") <= most * total)).select("term")


def following(keys: DataFrame, key: str) -> DataFrame:
    """(key, next) for distinct ascending integers; next of the last is null.

    Keys are dealt to sorted ranges, whatever their gaps are. The next key is in the same range, or it is the first of
    the next range, of which there is one row each.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(keys.select(key).repartitionByRange(n, key).withColumn("range", F.spark_partition_id()), "ranges")
    rows = ranged.withColumn("next", F.lead(key).over(Window.partitionBy("range").orderBy(key)))
    heads = ranged.groupBy("range").agg(F.min(key).alias("head"))  # at most n rows
    heads = heads.select("range", F.lead("head").over(Window.orderBy("range")).alias("then"))
    ends = rows.where("next is null").join(F.broadcast(heads), "range").select(key, F.col("then").alias("next"))
    return rows.where("next is not null").select(key, "next").unionByName(ends)


def with_next(documents: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """(doc_id, void, block, last, text, next_text), and the window that orders them: next_text is the text of the
    next doc_id, after the last that of the first; of one doc_id's texts, in their order.

    Texts are dealt once, to blocks of 256 consecutive ids, where the next one is at hand. Each block also gets a
    copy of the first text of the block after it (rows with ``last``). Rows without an id have no next (void).
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.col("doc_id").isNull().alias("void"), F.coalesce(F.shiftright("doc_id", FAN_BITS), F.xxhash64("text")).alias("block"), F.lit(False).alias("last"), "text")
    heads = materialize(rows.where("not void").groupBy("block").agg(F.min("doc_id").alias("head")), "heads")
    order = following(heads.select(F.col("block").alias("at")), "at").withColumnsRenamed({"at": "block"}).withColumnsRenamed({"block": "before", "next": "block"})
    first = heads.agg(F.min("block")).first()[0]
    order = order.withColumn("block", F.coalesce("block", F.lit(first))).join(heads, "block").select(F.col("before").alias("to"), F.col("head").alias("doc_id"))
    order = materialize(order, "heads")
    ahead = rows.select("doc_id", "text").join(order, "doc_id").groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    ahead = ahead.select("doc_id", F.lit(False).alias("void"), F.col("to").alias("block"), F.lit(True).alias("last"), "text")
    own = Window.partitionBy("void", "block").orderBy("last", "doc_id", "text")
    return rows.unionByName(ahead).withColumn("next_text", F.when(F.col("void"), "").otherwise(F.coalesce(F.lead("text").over(own), F.lit("")))), own


SENTINEL = -1


def _keep(k: int, bit: int):
    return lambda t: F.xxhash64(t, F.lit(k)).bitwiseAND(F.lit(bit)) == 0


def _fingerprints(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds to sorted lexicon terms ``<name>_in`` and a hash of all terms ``<name>_all`` the array ``<name>_h`` of subset hashes;
    '' stands for a subset in which the text has no term."""
    short = lambda h: F.right(F.concat(F.lit("0" * DIGITS), F.hex(h)), F.lit(DIGITS))
    digits = lambda a: F.when(F.size(a) > 0, short(F.xxhash64(a))).otherwise("")
    whole = lambda n: F.when(F.size(f"{n}_in") > 0, short(F.xxhash64(f"{n}_in"))).when(F.col(f"{n}_all").isNull(), "").otherwise(short(F.col(f"{n}_all")))
    df = df.withColumns({f"{n}_h": F.array(whole(n)) for n in names})
    df = df.withColumns({f"{n}_{k}": F.col(f"{n}_in") for n in names for k in range(SUBSETS)})
    for scale in range(1, SCALES):
        df = df.withColumns({f"{n}_{k}": F.filter(f"{n}_{k}", _keep(k, 1 << (scale - 1))) for n in names for k in range(SUBSETS)})
        df = df.withColumns({f"{n}_h": F.concat(f"{n}_h", F.array(*[digits(F.col(f"{n}_{k}")) for k in range(SUBSETS)])) for n in names})
    return df.drop(*[f"{n}_{k}" for n in names for k in range(SUBSETS)], *[f"{n}_{x}" for n in names for x in ("in", "all")])


def _lexicon_terms(rows: DataFrame, keys: list[str], texts: dict[str, str], words: DataFrame, extra: list[str]) -> DataFrame:
    """For each row (unique in ``keys``): ``extra``, and for each text its sorted lexicon terms and a hash of all its terms.

    The terms of all texts of a row are exploded once, behind a sentinel that every row has and that carries the
    other columns; position tells the texts apart. The lexicon is bounded (see above), and its join a broadcast up to a size;
    the rows of a key stay in the task they are in, if that is how they are partitioned.
    """
    names = list(texts)
    rows = rows.withColumns({f"{n}_t": terms(F.col(c)) for n, c in texts.items()})
    rows = rows.withColumns({f"{n}_all": F.when(F.size(f"{n}_t") > 0, F.xxhash64(F.array_sort(f"{n}_t"))) for n in names})
    rows = rows.withColumns({f"{n}_n": F.size(f"{n}_t") for n in names})
    carried = [*extra, *[f"{n}_all" for n in names]]
    every = F.concat(F.array(F.lit(SENTINEL).cast("long")), *[F.col(f"{n}_t") for n in names])
    split = rows.select(*keys, *carried, *[f"{n}_n" for n in names], F.posexplode(every).alias("pos", "term"))
    known = words.unionByName(words.sparkSession.range(1).select(F.lit(SENTINEL).cast("long").alias("term")))
    split = split.join(F.broadcast(known) if words.count() <= BROADCAST_TERMS else known, "term")
    head = F.col("pos") == 0
    upto, side = F.lit(0), {}
    for n in names:
        side[n] = (F.col("pos") > upto) & (F.col("pos") <= upto + F.col(f"{n}_n"))
        upto = upto + F.col(f"{n}_n")
    split = split.select(*keys, *[F.when(head, F.col(c)).alias(c) for c in carried], *[F.when(side[n], F.col("term")).alias(f"{n}_in") for n in names])
    return split.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], *[F.array_sort(F.collect_list(f"{n}_in")).alias(f"{n}_in") for n in names])


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the subsets in which either has terms; of two texts without words, 1."""
    pairs = F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: (p["x"] != "") | (p["y"] != ""))
    equal = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(F.size(pairs) == 0, 1.0).otherwise(equal / F.size(pairs))


def fingerprint(documents: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """One row for each doc_id and text: doc_id and fingerprint of the whole text; see ``compare_edited`` for edge cases."""
    words = materialize(lexicon(documents, least, most), "lexicon")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5("text"))
    out = _fingerprints(_lexicon_terms(rows, ["doc_id", "digest"], {"own": "text"}, words, []), ["own"])
    return out.select("doc_id", F.array_join("own_h", "-").alias("fingerprint"))


def compare_edited(documents: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n_chars / 2) code points give way to the
    first as many of the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    empty. A text without a term of the lexicon has the hash of all its terms alone; one without words has an empty
    fingerprint, like 1 to another such and 0 to any other. A row without a doc_id is edited with an empty text
    and compared with an empty next one. Rows that repeat a doc_id follow each other. Other columns are not read. An
    empty table gives an empty one. A very long text is one row of its distinct terms, and its cost grows with them.
    """
    words = materialize(lexicon(documents, least, most), "lexicon")
    rows, own = with_next(documents)
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("rn", F.row_number().over(own))
    rows = _lexicon_terms(rows, ["void", "block", "rn"], {"own": "text", "new": "edited"}, words, ["doc_id", "last", "n_chars", "edited_sha256"])
    rows = _fingerprints(rows, ["own", "new"])
    own = Window.partitionBy("void", "block").orderBy("rn")
    none = F.array_repeat(F.lit(""), 1 + SUBSETS * (SCALES - 1))
    rows = rows.withColumn("next_h", F.when(F.col("void"), none).otherwise(F.coalesce(F.lead("own_h").over(own), none)))
    return rows.where("not last").select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("own_h", "-").alias("fingerprint"), F.array_join("new_h", "-").alias("edited_fingerprint"),
        likeness("own_h", "new_h").alias("near_edited"), likeness("own_h", "next_h").alias("near_next"),
    )
