"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens, those with a digit made to <*>, lead down a tree: the number of tokens, then the leading tokens
(a quarter of them, from two to eight; lines of one or two tokens lead by all). In that leaf the rest of a line is
cut to at most sixteen fields, of one token each in lines of up to twenty tokens. A field is constant if at least three
lines of the leaf have it at that place; any other varies and becomes <*>. What comes out is the line's template. A
template with fewer than half its tokens constant, or with a varying field and fewer than three, says too little
and is none; in a line with digits, tokens without letters don't count as constant.

A template recurs if at least three unrelated texts have it. Equal texts count once. Texts that are near copies are
told apart from texts that only share some lines by a sketch, eighteen minima of hashes of clauses. Texts that agree
in a band of three minima are related. A template also needs a fifth as many unrelated texts as texts, so a large group of near copies, a few of
which any sketch misses, makes nothing recur. Copies are left to the operators for documents.

Lines of a recurring template are dropped, except in the text of the smallest doc_id that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.storage import discard, materialize

FIELDS, LEAST_LEAD, MOST_LEAD = 16, 2, 8
MIN_TEXTS, UNRELATED = 3, 0.2
BANDS, ROWS = 6, 3
SPACE = r"[\x20\x09-\x0D]+"
_CLAUSE = r"[.,;:!?\n][ \t\n\r.,;:!?]*"
_LETTER = r"\p{L}"
_LAST = (1 << 63) - 1
#: A minimum is that of the hashes' exclusive or with one of these: multiples of the golden ratio's 64 bits, cut to 60.
MASKS = [(k + 1) * 0x9E3779B97F4A7C15 % (1 << 60) for k in range(BANDS * ROWS)]


def hash_of(text: Column) -> Column:
    """The first 60 bits of the md5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def tokens(line: Column) -> Column:
    """The line's tokens, <*> for one with a digit."""
    odd = line.startswith(" ") | line.endswith(" ")
    for c in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | line.contains(c)
    plain = F.when(odd, F.filter(F.split(line, SPACE), lambda t: t != "")).otherwise(F.split(line, " "))
    return F.when(line.rlike("[0-9]"), F.transform(plain, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))).otherwise(plain)


def leaves(texts: DataFrame) -> DataFrame:
    """(digest, text) to a row for each line with tokens: digest, pos, leaf, line, n, named (constant tokens of the
    lead), width, and the fields' hashes h and constant tokens c.

    In a line with digits only tokens with letters are constant; c is null for lines without, where all are."""
    rows = texts.select("digest", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("digest", "pos", F.col("raw").rlike("[0-9]").alias("digits"), tokens(F.col("raw")).alias("t")).withColumn("n", F.size("t"))
    lead = F.when(F.col("n") <= LEAST_LEAD, F.col("n")).otherwise(F.least(F.lit(MOST_LEAD), F.greatest(F.lit(LEAST_LEAD), F.ceil(F.col("n") / 4)))).cast("int")
    rows = rows.withColumn("lead", lead).withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("lead")) / FIELDS)).cast("int"))
    rows = rows.withColumn("m", F.ceil((F.col("n") - F.col("lead")) / F.col("width")).cast("int"))
    part = lambda j: F.slice("t", F.col("lead") + 1 + j * F.col("width"), F.col("width"))
    places = F.when(F.col("m") > 0, F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array().cast("array<int>"))
    named = lambda a: F.size(F.filter(a, lambda t: t.rlike(_LETTER)))
    head = F.slice("t", F.lit(1), F.col("lead"))
    return rows.select(
        "digest", "pos", F.xxhash64("n", head).alias("leaf"), F.xxhash64(F.lit(1), "t").alias("line"), "n",
        F.when(F.col("digits"), named(head)).otherwise(F.col("lead")).alias("named"), "width",
        F.transform(places, lambda j: F.xxhash64(part(j))).alias("h"), F.when(F.col("digits"), F.transform(places, lambda j: named(part(j)))).alias("c"),
    )


def templates(lines: DataFrame) -> DataFrame:
    """(leaf, line, template) of the lines that have one."""
    each = lines.groupBy("leaf", "line", "n", "named", "width", "h", "c").agg(F.count("*").alias("lines"))
    each = materialize(each, "lines")
    place = F.posexplode_outer(F.arrays_zip("h", F.coalesce("c", F.transform("h", lambda x: F.lit(None).cast("int"))).alias("c"))).alias("j", "field")
    split = each.select("leaf", "line", "n", "named", "width", F.size("h").alias("m"), "lines", place).select("*", "field.h", "field.c").drop("field")
    # the last field has what is left
    rest = F.col("n") - F.col("named") - (F.col("m") - 1) * F.col("width")
    split = split.withColumn("c", F.coalesce("c", F.when(F.col("j") < F.col("m") - 1, F.col("width")).otherwise(rest)))
    often = split.where("h is not null").groupBy("leaf", "j", "h").agg(F.sum("lines").alias("k")).where(F.col("k") >= MIN_TEXTS)
    often = materialize(often.select("leaf", "j", "h", F.lit(True).alias("constant")), "fields")  # so that the join may split a hot field
    split = split.join(often, ["leaf", "j", "h"], "left").withColumn("varies", F.col("h").isNotNull() & F.col("constant").isNull())
    body = F.bit_xor(F.xxhash64("j", F.when(~F.col("varies"), F.col("h")))).alias("template")
    found = split.groupBy("leaf", "line", "n", "named").agg(body, F.sum(F.when(F.col("varies") | F.col("h").isNull(), 0).otherwise(F.col("c"))).alias("c"), F.max("varies").alias("varies"))
    constant = F.col("named") + F.col("c")
    return found.where((constant * 2 >= F.col("n")) & (~F.col("varies") | (constant >= 3))).select("leaf", "line", "template")


def related(documents: DataFrame) -> DataFrame:
    """(digest, first, related): of each distinct text its smallest doc_id and the smallest digest of a band it is in."""
    clauses = F.filter(F.split("text", _CLAUSE), lambda c: c != "")
    rows = documents.select("digest", F.coalesce("doc_id", F.lit(_LAST)).alias("first"), F.transform(clauses, hash_of).alias("pieces"))

    def minimum(mask: int) -> Column:
        return F.array_min(F.transform("pieces", lambda x: x.bitwiseXOR(F.lit(mask))))

    names = [f"m{k}" for k in range(len(MASKS))]
    rows = rows.select("digest", "first", *[minimum(mask).alias(name) for mask, name in zip(MASKS, names, strict=True)])
    rows = materialize(rows.groupBy("digest", *names).agg(F.min("first").alias("first")), "sketches")
    bands = F.array(*[F.struct(F.lit(b).alias("b"), *[F.col(names[ROWS * b + r]).alias(f"m{r}") for r in range(ROWS)]) for b in range(BANDS)])
    bands = rows.where("m0 is not null").select("digest", F.explode(bands).alias("band"))
    low = bands.groupBy("band").agg(F.min("digest").alias("related"), F.max("digest").alias("high")).where("related < high").select("band", "related")
    low = materialize(low, "bands")  # so that the join may split a hot band
    near = bands.join(low, "band").groupBy("digest").agg(F.min("related").alias("related"))
    return rows.select("digest", "first").join(near, "digest", "left").select("digest", "first", F.coalesce("related", "digest").alias("related"))


def recurring(documents: DataFrame) -> DataFrame:
    """(digest, drops): of each text that has some the positions of the lines to drop; of (digest, doc_id, text)."""
    every = materialize(leaves(documents.select("digest", "text")), "leaves")
    some = every.groupBy("leaf").agg(F.count("*").alias("k"), F.min(F.xxhash64("digest")).alias("a"), F.max(F.xxhash64("digest")).alias("b"))
    some = materialize(some.where((F.col("k") >= MIN_TEXTS) & (F.col("a") < F.col("b"))).select("leaf"), "shared")
    lines = materialize(every.join(some, "leaf", "left_semi").distinct(), "shared")  # equal texts once
    discard(every, some)
    known = materialize(templates(lines), "templates")
    texts = materialize(related(documents), "texts")
    rows = lines.select("digest", "pos", "leaf", "line").join(known, ["leaf", "line"]).join(texts, "digest")
    rows = materialize(rows.select("digest", "pos", "leaf", "template", "first", "related"), "rows")
    discard(lines, known, texts)
    count = rows.groupBy("leaf", "template", "related", "digest").agg(F.min("first").alias("first"))
    count = count.groupBy("leaf", "template", "related").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    count = count.groupBy("leaf", "template").agg(F.count("*").alias("unrelated"), F.sum("texts").alias("texts"), F.min("first").alias("keeper"))
    count = count.where((F.col("unrelated") >= MIN_TEXTS) & (F.col("unrelated") >= UNRELATED * F.col("texts"))).select("leaf", "template", "keeper")
    count = materialize(count, "recurring")
    return rows.join(count, ["leaf", "template"]).where("first > keeper").groupBy("digest").agg(F.collect_set("pos").alias("drops"))


def drop_lines(documents: DataFrame) -> DataFrame:
    """All columns of ``documents``, text without the dropped lines, and n_lines, n_dropped.

    Lines end with a line feed. A null text stays null with no lines; an empty one is one line without tokens, and
    lines without tokens are never dropped. A document that loses all its lines has an empty text. Rows without a
    doc_id keep a recurring line only if all that have it are such. Rows with equal texts are treated alike: all
    copies of the text that keeps a line keep it. Very long texts cost time and memory in proportion to their
    length. An empty table gives an empty one. Column names of the input are kept apart from the operator's own by
    a struct.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("all"))
    docs = docs.withColumn("digest", F.md5("text"))
    drops = recurring(docs.where("text is not null").select("digest", "doc_id", "text"))
    # merge-joined at any size: a plan that broadcasts drops while they are few tells nothing of a larger corpus
    out = docs.join(drops.hint("merge"), "digest", "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_sort(F.array_except(F.sequence(F.lit(1), F.size("lines")), F.transform("drops", lambda p: p + 1)))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(F.col("lines"), i)), "\n"))
    fields = [text.alias(c) if c == "text" else F.col("all").getField(c).alias(c) for c in documents.columns]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long")
    return out.select(*fields, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def drop_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text that is left; null if it is null)."""
    out = drop_lines(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
with tx as (
  select md5(text) as digest, any_value(text) as text, min(coalesce(doc_id, 9223372036854775807)) as first
  from documents where text is not null group by 1),
raw as (select digest, unnest(range(len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from tx),
tok as (
  select digest, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as t from raw),
led as (
  select *, len(t) as n, case when len(t) <= 2 then len(t) else least(8, greatest(2, ceil(len(t) / 4)))::int end as k
  from tok where len(t) > 0),
cut as (select *, greatest(1, ceil((n - k) / 16))::int as w, t[1:k] as head from led),
line as (
  select digest, pos, n, w, head, t, list_transform(range(0, ceil((n - k) / w)::int), lambda j: t[k + 1 + j * w : least(n, k + (j + 1) * w)]) as fields from cut),
piece as (
  select digest, cast('0x' || substr(md5(c), 1, 15) as bigint) as x
  from (select digest, unnest(string_split_regex(text, '[.,;:!?\n][ \t\n\r.,;:!?]*')) as c from tx) where c <> ''),
minima as (select digest, {minima} from piece group by 1),
bands as ({bands}),
low as (select band, min(digest) as related from bands group by band),
kin as (select digest, min(related) as related from bands join low using (band) group by digest),
field as (select n, head, t, unnest(range(len(fields))) as j, unnest(fields) as f from line),
often as (select n, head, j, f from field group by all having count(*) >= 3),
known as (select distinct n, head, t, fields from line),
part as (select n, head, t, unnest(range(len(fields))) as j, unnest(fields) as f from known),
body as (
  select p.n, p.head, p.t, list(case when o.f is null then ['<*>'] else p.f end order by p.j) as body, bool_or(o.f is null) as varies,
         sum(case when o.f is null then 0 else len(list_filter(p.f, lambda x: not list_contains(p.t, '<*>') or regexp_matches(x, '\pL'))) end) as c
  from part p left join often o on p.n = o.n and p.head = o.head and p.j = o.j and p.f = o.f group by all),
tpl as (
  select l.n, l.head, l.t, coalesce(b.body, []) as body, coalesce(b.varies, false) as varies,
         len(list_filter(l.head, lambda x: not list_contains(l.t, '<*>') or regexp_matches(x, '\pL'))) + coalesce(b.c, 0) as constant
  from known l left join body b using (n, head, t)),
hit as (
  select line.digest, line.pos, tpl.n, tpl.head, tpl.body, tx.first, coalesce(kin.related, line.digest) as related
  from line join tpl using (n, head, t) join tx using (digest) left join kin using (digest)
  where constant * 2 >= tpl.n and (not varies or constant >= 3)),
rec as (
  select n, head, body, min(first) as keeper from hit group by all
  having count(distinct related) >= 3 and count(distinct related) >= 0.2 * count(distinct digest)),
gone as (select hit.digest, list(hit.pos) as drops from hit join rec using (n, head, body) where first > keeper group by 1),
d as (select doc_id, text, md5(text) as digest, string_split(text, chr(10)) as lines from documents)
select doc_id, coalesce(len(lines), 0)::bigint as n_lines, coalesce(len(drops), 0)::bigint as n_dropped,
       sha256(case when drops is null then text else array_to_string(
         list_transform(list_filter(range(len(lines)), lambda i: not list_contains(drops, i)), lambda i: lines[i + 1]), chr(10)) end) as kept_sha256
from d left join gone using (digest)
""".replace("{minima}", ", ".join(f"min(xor(x, {mask})) as m{k}" for k, mask in enumerate(MASKS))).replace(
    "{bands}", " union all ".join(f"select digest, [{', '.join(['0'] * b + ['1'])}, m{3 * b}, m{3 * b + 1}, m{3 * b + 2}] as band from minima" for b in range(BANDS))
)
