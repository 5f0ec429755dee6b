"""Operator 10: personal data, base patterns plus information-theoretic sanitisation; DataFrame functions only.

Base spans are the contract's patterns (email, ip, card, phone), leftmost and not
overlapping per kind; matches that fail their test are dropped.  The method adds two kinds:

``secret``  an unbroken run of letters, digits, - and _ of 20 characters or more, with at
least four letters and four digits and an entropy of its characters of 3 bits or more.

``term``    a word that reveals a protected entity elsewhere.  Protected are each distinct
value of a span, and each kind of span as such.  Over all distinct texts, a term t of whole
texts discloses an entity e by
    pmi(e, t) / -log p(e) = 1 + log p(e | t) / -log p(e)
with p(e | t) smoothed by PRIOR texts that hold e as often as any text does.  Texts of
one source are one piece of evidence: near copies (which agree in a band of three of 24
least hashes of five-word shingles, over two steps) are one source, and a term needs SUPPORT
sources that hold both.  A value with more sources than a share PUBLIC of all texts, and than COMMON, protects
nobody.  A term
that discloses by at least GENERALISE is a span: that of a value wherever it stands in any text, that
of a kind in texts with a span of that kind.  In sanitised text it is generalised to
<TERM>, from REMOVE on it is removed; other spans become <EMAIL>, <IP>, <CARD>, <PHONE>, <SECRET>.

Long texts: patterns read every run of characters once (a match can only begin where a run
or the match before it ends), positions are running totals made chunk by chunk, and text is cut
from blocks, so the work grows with the length; the pairs of a text's live entities and terms are counted one by
one and never gathered.

Defined results: null text is empty; positions are code points, ends exclusive; a secret or term
that overlaps a base span is left out; repeated rows get equal results; an empty
table gives no rows; other columns are ignored (and kept by ``sanitised``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, pinned, texts, unpacked

# The kinds in order and their patterns, as the contract has them but for where a match may begin and possessive repeats, which give the same matches without reading a run twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "secret", "term"]
SECRET, TERM = 4, 5
SUPPORT, PRIOR, PUBLIC, COMMON, GENERALISE, REMOVE = 3, 4.0, 0.1, 10, 0.8, 0.95
BANDS, ROWS, SHINGLE = 8, 3, 5
#: Flagged terms that may be broadcast.
FEW = 200_000
CHUNK, BLOCK = 256, 1024
_SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
_TERM = r"[\p{L}\p{N}]+"
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def bound(value: Column, of) -> Column:
    """of(value) with value evaluated once."""
    return F.transform(F.array(value), of)[0]


def running(values: Column, op, kind: str = "int") -> Column:
    """Running totals under op of an array: within chunks, then of the chunks, so that no fold copies a long array."""

    def fold(x: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        first = F.struct(F.lit(None).cast(kind).alias("sum"), none.alias("all"))

        def step(done: Column, v: Column) -> Column:
            return bound(F.when(done["sum"].isNull(), v).otherwise(op(done["sum"], v)), lambda t: F.struct(t.alias("sum"), F.concat(done["all"], F.array(t)).alias("all")))

        return F.aggregate(x, first, step, lambda done: done["all"])

    def joined(chunks: Column) -> Column:
        return bound(fold(F.transform(chunks, lambda c: F.element_at(c, -1))), lambda bases: F.flatten(F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda v: op(F.get(bases, i - 1), v))))))

    def whole(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: fold(F.slice(x, i * CHUNK + 1, F.lit(CHUNK))))
        return F.when(F.size(x) > 0, bound(chunks, joined)).otherwise(F.array().cast(f"array<{kind}>"))

    return bound(values, whole)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + bound(F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))

    return bound(_digits(value), lambda d: F.when(F.length(d).between(16, 19), total(d) % 10 == 0).otherwise(F.lit(False)))


def entropy(value: Column) -> Column:
    """Bits for each character, by the characters' own frequencies."""
    often = F.transform(F.array_distinct(F.split(value, "")), lambda c: F.length(value) - F.length(F.replace(value, c, F.lit(""))))
    return F.log2(F.length(value)) - F.aggregate(F.filter(often, lambda k: k > 0), F.lit(0.0), lambda s, k: s + k * F.log2(k)) / F.length(value)


def _random(value: Column) -> Column:
    mixed = value.rlike("(?:[0-9][^0-9]*+){4}") & value.rlike("(?:[A-Za-z][^A-Za-z]*+){4}")
    return F.when(mixed, entropy(value) >= 3.0).otherwise(F.lit(False))


_TESTS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def found(text: Column, kind: int, pattern: str, test=None) -> Column:
    """Spans of one kind in order; ``test`` drops matches.  Places come from what lies between the matches."""

    def spans(p: Column) -> Column:
        ends = running(F.transform(p["values"], lambda v, i: F.length(F.get(p["between"], i)) + F.length(v)), lambda a, b: a + b)
        all_ = bound(ends, lambda e: F.transform(p["values"], lambda v, i: F.struct(F.lit(kind).alias("kind"), (F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), v.alias("value"))))
        return F.filter(all_, lambda s: test(s["value"])) if test else all_

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("between"))
    return bound(pair, lambda p: F.when(F.size(p["values"]) > 0, spans(p)).otherwise(F.array().cast(_SPAN)))


#: What a text must hold for a kind to be looked for.
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}


def base_spans(text: Column) -> Column:
    return F.concat(*(F.when(text.rlike(_NEEDS[k]), found(text, i, p, _TESTS[k])).otherwise(F.array().cast(_SPAN)) for i, (k, p) in enumerate(PATTERNS.items())))


def apart(spans: Column, base: Column) -> Column:
    """The spans (with start and end) that overlap none of base, in order of start; reads both once."""
    def marked(x: Column, own: bool) -> Column:
        return F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), (s if own else F.get(F.slice(spans, 1, 1), 0)).alias("s")))

    def kept(both: Column) -> Column:
        past = running(F.transform(both, lambda m: F.when(m["own"], -1).otherwise(m["end"])), F.greatest)
        next_ = F.reverse(running(F.reverse(F.transform(both, lambda m: F.when(m["own"], F.lit(2147483647)).otherwise(m["start"]))), F.least))

        def free(x: Column) -> Column:
            alone = lambda m, i: m["own"] & (F.get(x["past"], i) <= m["start"]) & (F.get(x["next"], i) >= m["end"])
            return F.transform(F.filter(both, alone), lambda m: m["s"])

        return bound(F.struct(past.alias("past"), next_.alias("next")), free)

    both = F.sort_array(F.concat(marked(spans, True), marked(base, False)))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(bound(both, kept))


def all_spans(text: Column) -> Column:
    """Base spans and, after them, secrets."""
    secret = F.when(text.rlike("[A-Za-z0-9_-]{20}"), found(text, SECRET, _SECRET, _random)).otherwise(F.array().cast(_SPAN))
    return bound(base_spans(text), lambda base: F.concat(base, apart(secret, base)))


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _bands(text: Column) -> Column:
    """BANDS hashes, each of ROWS least hashes of the text's five-word shingles."""

    def of(words: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - SHINGLE + 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE))))
        least = lambda s, seed: F.array_min(F.transform(s, lambda x: F.xxhash64(x, F.lit(seed))))
        return bound(shingles, lambda s: F.array(*(F.xxhash64(F.lit(b), *(least(s, ROWS * b + r) for r in range(ROWS))) for b in range(BANDS))))

    return bound(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), of)


def _entities(spans: Column) -> Column:
    """(entity, kind) of the distinct values, and of the kinds, whose entity is the kind's number."""
    same = lambda s: F.xxhash64(s["kind"], F.when(s["kind"].isin(2, 3), _digits(s["value"])).otherwise(F.lower(s["value"])))
    pair = lambda e, k: F.struct(e.cast("long").alias("entity"), k.alias("kind"))
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.array(pair(same(s), F.lit(-1)), pair(s["kind"], s["kind"])))))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, th (of the text), spans of every row; terms and bands of texts with spans."""
    rows = texts(docs).select("doc_id", F.md5("text").alias("th"), "text", all_spans(F.col("text")).alias("spans"))
    if_any = lambda x: F.when(F.size("spans") > 0, x)
    return rows.select("doc_id", "th", "spans", if_any(terms(F.col("text"))).alias("terms"), if_any(_bands(F.col("text"))).alias("bands"))


def sources(private: DataFrame) -> DataFrame:
    """th, source: the same for near copies, in two steps of the least label along shared bands."""
    shared = pinned(private.select("th", F.explode("bands").alias("band")))
    label = private.select("th", F.xxhash64("th").alias("source"))
    for _ in range(2):
        of_band = shared.join(label, "th").groupBy("band").agg(F.min("source").alias("source"))
        label = pinned(shared.join(of_band, "band").groupBy("th").agg(F.min("source").alias("source")))
    return label


def frequencies(docs: DataFrame) -> DataFrame:
    """term, df: the distinct texts that hold a term."""
    once = texts(docs).select(F.md5("text").alias("th"), "text").dropDuplicates(["th"])
    return once.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def disclosing_terms(rows: DataFrame, frequency: DataFrame, support: int = SUPPORT, prior: float = PRIOR, public: float = PUBLIC, common: int = COMMON, generalise: float = GENERALISE) -> DataFrame:
    """entity, kind (-1: a value), term, disclosure of the terms from ``generalise`` on; rows as scanned() gives them."""
    n = rows.select("th").distinct().count()
    private = pinned(rows.where(F.size("spans") > 0).dropDuplicates(["th"]))
    label = sources(private)
    holds = private.select("th", F.explode(_entities(F.col("spans"))).alias("e")).select("th", "e.entity", "e.kind").join(label, "th")
    live = holds.groupBy("entity", "kind", "source").agg(F.count("*").alias("t")).groupBy("entity", "kind").agg(F.sum("t").alias("texts"), F.count("*").alias("sources"))
    live = pinned(live.where((F.col("sources") >= support) & (F.col("texts") < n) & ((F.col("kind") >= 0) | (F.col("sources") <= max(public * n, common)))).select("entity", "kind", "texts"))
    own = holds.join(live.select("entity", "kind"), ["entity", "kind"], "left_semi").groupBy("th", "source").agg(F.collect_list(F.struct("entity", "kind")).alias("entities"))
    pair = private.select("th", "terms").join(own, "th").select("source", "entities", F.explode("terms").alias("term")).select("source", "term", F.explode("entities").alias("e")).select("source", "term", "e.entity", "e.kind")
    pair = pair.groupBy("entity", "kind", "term", "source").agg(F.count("*").alias("t")).groupBy("entity", "kind", "term").agg(F.sum("t").alias("together"), F.count("*").alias("sources")).where(F.col("sources") >= support)
    pair = pinned(pair)
    asked = pinned(pair.select("term").distinct())  # only their frequencies are counted: the semi-join goes below the count
    frequency = frequency.join(F.broadcast(asked) if asked.count() <= FEW else asked, "term", "left_semi")
    scored = pair.join(live, ["entity", "kind"]).join(frequency, "term")
    p = F.col("texts") / F.lit(float(max(n, 1)))
    given = (F.col("together") + prior * p) / (F.col("df") + prior)
    return scored.select("entity", "kind", "term", (1 + F.log(given) / -F.log(p)).alias("disclosure")).where(F.col("disclosure") >= generalise)


def term_places(docs: DataFrame, rows: DataFrame, telling: DataFrame) -> DataFrame:
    """th, terms (start, end, disclosure, in order) of each text with terms that tell."""
    telling = pinned(telling.groupBy("kind", "term").agg(F.max("disclosure").alias("disclosure")))
    few = telling.count() <= FEW
    mark = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    held = rows.select("th", F.explode(F.array_distinct(F.transform("spans", lambda s: s["kind"]))).alias("kind")).distinct()
    all_texts = texts(docs).select(F.md5("text").alias("th"), "text")
    hits = all_texts.select("th", F.explode(terms(F.col("text"))).alias("term")).join(mark(telling), "term")
    told = hits.join(held.withColumn("_held", F.lit(True)), ["th", "kind"], "left").where("kind < 0 OR _held")
    told = pinned(told.groupBy("th", "term").agg(F.max("disclosure").alias("disclosure")))
    # a text's own telling terms are a small map beside it, so its words are looked up where they are
    own = told.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_told"))
    if told.count() <= FEW:
        own = F.broadcast(own)
    once = all_texts.join(own, "th").dropDuplicates(["th"])
    placed = F.transform(found(F.col("text"), TERM, _TERM), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.try_element_at("_told", F.xxhash64(F.lower(w["value"]))).alias("disclosure")))
    return once.select("th", F.filter(placed, lambda w: w["disclosure"].isNotNull()).alias("terms"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _places(docs: DataFrame, **rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, spans) of every row; (th, terms) of each text with term spans."""
    rows = pinned(scanned(docs))
    # pinned, so that the join with rows reads two exchanges and the copies of one text are split
    return rows, pinned(term_places(docs, rows, disclosing_terms(rows, frequencies(docs), **rule)))


def _with_terms(rows: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    both = rows.join(places.select(F.col("th").alias("_of"), F.col("terms").alias("_terms")), F.col("th") == F.col("_of"), "left")
    return both.select(*columns, "spans", apart(F.coalesce("_terms", none), F.col("spans")).alias("terms"))


def pii_spans(docs: DataFrame, **rule) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_spans; rule: as disclosing_terms() takes it."""
    rows, places = _places(docs, **rule)
    out = _with_terms(rows.select("doc_id", "th", "spans"), places, "doc_id")
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < SECRET)
    extra = F.transform("terms", lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.lit("").alias("value")))
    return out.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)), F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"), _joined(F.concat("spans", extra)).alias("spans"),
        count(SECRET).alias("n_secret"), F.size("terms").cast("long").alias("n_term"), (F.size("spans") + F.size("terms")).cast("long").alias("n_spans"),
    )


def _replaced(text: Column, spans: Column) -> Column:
    """text with the spans (start, end, as; in order) replaced; of overlapping ones the first begins the cut and the later only lengthen it."""

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(some, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))

    def cut(x: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(x["ends"], i - 1))
        each = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(x["blocks"], before(i), s["start"]), s["as"])).otherwise(F.lit("")))
        return F.concat(F.array_join(each, ""), piece(x["blocks"], F.element_at(x["ends"], -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return bound(F.struct(running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("ends"), blocks.alias("blocks")), cut)


def sanitised(docs: DataFrame, remove: float = REMOVE, **rule) -> DataFrame:
    """The rows and columns of docs with spans generalised or removed (terms from ``remove`` on) in text, and n_chars as it is then."""
    _, places = _places(docs, **rule)
    rows = packed(docs).withColumn("th", F.md5("text")).withColumn("spans", all_spans(F.col("text")))
    out = _with_terms(rows, places, "_row", "text")
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("as")))
    more = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosure"] >= remove, F.lit("")).otherwise(F.lit("<TERM>")).alias("as")))
    clean = bound(F.sort_array(F.concat(base, more)), lambda spans: _replaced(F.col("text"), spans))
    return unpacked(out.withColumn("_clean", F.when(F.size("spans") + F.size("terms") > 0, clean)), docs.columns, F.col("_clean"))
