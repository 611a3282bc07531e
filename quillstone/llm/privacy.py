"""Personal data: patterns, and information-theoretic sanitisation of the terms that give them away.

Patterns find e-mail addresses, IP addresses, card numbers and telephone numbers with
their places. Each distinct value is an entity. An entity that stands in at least
SUPPORT different texts is protected: its information content is IC(c) = log N / n(c)
over the N documents. A term t reveals it to the extent of their pointwise mutual
information, log N n(c,t) / (n(c) n(t)), estimated from the documents in which both stand.
Terms that share SUPPORT different texts with an entity (copies are no evidence) and whose
information reaches DISCLOSURE of IC(c) are disclosing: a term may stand in some texts
without the entity, the more of them the rarer the entity is, n(c,t) / n(t) being at least
(n(c) / N) ** (1 - DISCLOSURE). Such a term is generalised to its first letters if these do
not disclose an entity themselves, and removed otherwise, in the texts that hold an entity
which it discloses; texts without personal data are left alone.

Everything is DataFrame functions. Spans are found once and stored. Co-occurrences are
counted over the different texts with a protected entity, where entities and terms are
joined by text. The rows n(t) of a term are counted over all texts: words pass a broadcast
table of at most BUCKETS hash buckets first, so that only likely terms are shuffled. No
term list is broadcast.

Places are code points, end exclusive. Places come from the matches and the gaps between
them; possessive quantifiers and look-behind keep the patterns linear on long runs without
changing what they match.

Defined results: null and empty texts have no spans. Repeated rows give equal rows, an
empty table an empty result. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import read, stored

#: Kinds in the order of all results, each with its pattern.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have before its pattern is tried.
HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"[\p{L}\p{N}]+"
SUPPORT = 3
DISCLOSURE = 0.9
#: Letters of a generalised term.
STEM = 3
BUCKETS = 1 << 18
#: Matches whose spans are collected at once.
CHUNK = 256

SPANS = "array<struct<start:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def with_spans(df: DataFrame, text: str, pattern: str, out: str, where: Column, keep) -> DataFrame:
    """Add `out`: start, end and value of the leftmost non-overlapping matches in column `text` that `keep` holds of.

    Matches and the gaps between them are laid end to end, CHUNK at a time: what is
    kept of a chunk is appended to the chunks before it, so that very long texts do
    not copy one growing list for each match. Only rows that `where` holds of are searched.
    """
    empty = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))
    found = F.when(where, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_found", found).withColumn(
        "_pairs", F.when(F.size("_found") > 0, F.arrays_zip(F.split(F.col(text), pattern).alias("gap"), F.col("_found").alias("value")))
    )

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(keep(pair["value"]), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def chunk(acc: Column, first: Column) -> Column:
        begin = F.struct(F.element_at(acc, -1)["at"].alias("at"), no_spans().alias("out"))
        many = F.least(F.lit(CHUNK), F.size("_pairs") - first)  # the gap after the last match has no value
        return F.concat(acc, F.array(F.aggregate(F.slice("_pairs", first, many), begin, step)))

    firsts = F.sequence(F.lit(1), F.size("_pairs") - 1, F.lit(CHUNK))
    spans = F.aggregate(firsts, F.array(empty), chunk, lambda acc: F.flatten(F.transform(acc, lambda c: c["out"])))
    return df.withColumn(out, F.when(F.size("_pairs") > 1, spans).otherwise(no_spans())).drop("_found", "_pairs")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def double(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + double(i))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == "card":
        digits = digits_of(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(value)).between(8, 15)
    return F.lit(True)


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add a column of spans for each kind; texts without a kind's hint are not searched for it."""
    for kind, pattern in PATTERNS.items():
        df = with_spans(df, text, pattern, kind, F.regexp_like(F.col(text), F.lit(HINTS[kind])), checked(kind))
    return df


def checked(kind: str):
    return lambda value: valid(kind, value)


def named(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s["value"]))


def outside(text: Column) -> Column:
    """The text without what may be an entity: its terms are not parts of one. A number is one from 16 digits on."""
    numbers = {**PATTERNS, "card": r"[0-9](?:[\x20-]?[0-9]){15,}+"}
    return F.when(F.regexp_like(text, F.lit("[0-9@]")), reduce(lambda t, p: F.regexp_replace(t, p, " "), numbers.values(), text)).otherwise(text)


def words_of(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def with_stems(words: Column) -> Column:
    """Terms: words, and their stems (with a star)."""
    return F.array_distinct(F.concat(words, F.transform(words, stem)))


def stem(word: Column) -> Column:
    return F.concat(F.substring(word, 1, STEM), F.lit("*"))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def tagged_rows(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """_row, doc_id, the spans of each kind, and of rows with a span (of all with `keep_text`) the text; _copy tells equal texts with a span."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = with_base_spans(docs.select("doc_id", text.alias("text")), "text")
    held = F.size(F.flatten(F.array(*PATTERNS))) > 0
    kept = F.col("text") if keep_text else F.when(held, F.col("text"))
    return stored(rows.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", *PATTERNS, kept.alias("text"), F.when(held, F.sha2("text", 256)).alias("_copy")), "pii-rows")


def same_texts(copy: str) -> list[Column]:
    """Aggregates that tell sets of texts apart, whatever their order and size (128 bits)."""
    return [F.bit_xor(F.xxhash64(copy)).alias("h1"), F.bit_xor(F.xxhash64(copy, F.lit(1))).alias("h2")]


def disclosures(docs: DataFrame, rows: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame] | None:
    """entity, term of what discloses a protected entity; and copy, term of the texts in which both stand. None if no term can.

    Entities and terms of a text are kept apart, a row each; they only meet after terms of
    too few or too many texts, and entities of too few, are gone. Entities that stand in
    the same texts are one here: a list of addresses that is repeated is one entity.
    """
    tagged = [F.transform(k, named(k)) for k in PATTERNS]
    found = rows.where("_copy is not null").select("_copy", "text", F.array_distinct(F.flatten(F.array(*tagged))).alias("entities"))
    texts = found.groupBy(F.col("_copy").alias("copy")).agg(F.first("text").alias("text"), F.first("entities").alias("entities"), F.count(F.lit(1)).alias("n"))
    texts = stored(texts.select("copy", "n", "entities", words_of(outside(F.col("text"))).alias("words")), "pii-texts")
    seen = texts.select("copy", "n", F.explode("entities").alias("entity"))
    protected = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_c"), *same_texts("copy")).where(F.col("texts") >= support)
    protected = stored(protected.groupBy("texts", "n_c", "h1", "h2").agg(F.min("entity").alias("entity")).select("entity", "n_c"), "protected")
    most = protected.agg(F.max("n_c")).first()[0]
    if most is None:
        return None
    n_rows = float(rows.count())
    guarded = stored(seen.join(protected, "entity"), "guarded")
    words = texts.join(guarded.select("copy").distinct(), "copy", "left_semi").select("copy", F.explode(with_stems(F.col("words"))).alias("term"), "n")
    # a term's rows among these texts bound its rows from below: words that go with too many are out before they are joined
    within = words.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_w"))
    within = within.where((F.col("texts") >= support) & (F.col("n_w") <= most ** disclosure * n_rows ** (1 - disclosure) * (1 + 1e-9)))
    terms = stored(words.select("copy", "term").join(within.select("term", "n_w"), "term"), "pii-terms")
    content = F.log(F.lit(n_rows) / F.col("n_c"))
    bound = lambda n: F.log(F.lit(n_rows) * F.col("n_ct") / (F.col("n_c") * F.col(n)))
    pairs = guarded.join(terms, "copy").groupBy("entity", "n_c", "term", "n_w").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_ct"))
    pairs = pairs.where((F.col("texts") >= support) & (content > 0) & (bound("n_w") >= disclosure * content - 1e-9))
    together = stored(pairs.select("entity", "n_c", "term", "n_ct"), "together")
    # BUCKETS rows at most: all other words of the corpus end here, before they are shuffled
    buckets = stored(together.select(bucket(F.col("term")).alias("b")).distinct(), "term-buckets")
    if buckets.isEmpty():
        return None
    words = docs.select(F.explode(with_stems(words_of(outside(F.coalesce(docs["text"], F.lit("")))))).alias("term"))
    likely = words.withColumn("b", bucket(F.col("term"))).join(F.broadcast(buckets), "b", "left_semi")
    frequency = likely.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    disclosing = stored(together.join(frequency, "term").where(bound("n_t") >= disclosure * content - 1e-9).select("entity", "term"), "disclosing")
    held = terms.select("copy", "term").join(disclosing, "term").join(guarded.select("entity", "copy"), ["entity", "copy"])
    return disclosing, held.select("copy", "term").distinct()


def with_actions(found: DataFrame) -> DataFrame:
    """term, action: what the terms of `found` become, their stem or '' if they are removed."""
    terms = found.select("term").distinct()
    stems = terms.where(F.endswith("term", F.lit("*"))).select(F.col("term").alias("_stem"))
    words = terms.where(~F.endswith("term", F.lit("*")))
    return words.join(stems, stem(F.col("term")) == F.col("_stem"), "left").select(
        "term", F.when(F.col("_stem").isNull(), stem(F.col("term"))).otherwise("").alias("action")
    )


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """term, action: the terms that disclose a protected entity, and the stem they become ('' if they are removed)."""
    got = disclosures(docs, tagged_rows(docs), support, disclosure)
    return with_actions(got[0]) if got else docs.sparkSession.createDataFrame([], "term string, action string")


def find(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, the spans of each kind, and `terms`: start, end, value and action of disclosing terms. One row for every row."""
    rows = tagged_rows(docs, keep_text)
    out = rows.select("_row", "doc_id", *["text"] * keep_text, *PATTERNS)
    got = disclosures(docs, rows)
    if got is None:
        return out.withColumn("terms", F.lit(None).cast("array<struct<start:int,end:int,value:string,action:string>>")).drop("_row")
    disclosing, held = got
    terms = stored(held.join(with_actions(disclosing), "term").select(F.col("copy").alias("_copy"), "term", "action"), "terms")
    hit = rows.join(terms.select("_copy").distinct(), "_copy", "left_semi")
    hit = with_spans(hit, "text", TERM, "_words", F.lit(True), lambda value: F.lit(True))
    taken = F.flatten(F.array(*PATTERNS))
    free = F.filter("_words", lambda w: ~F.exists(taken, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    each = hit.select("_row", "_copy", F.explode(free).alias("w")).select("_row", "_copy", "w.*", F.lower("w.value").alias("term"))
    marks = each.join(terms, ["_copy", "term"]).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value", "action"))).alias("terms"))
    return out.join(marks, "_row", "left").drop("_row")


def marked(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("by"))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which patterns become [KIND], and disclosing terms their stem or [REMOVED]."""
    found = find(docs, keep_text=True)
    marks = [F.transform(F.col(k), marked(k)) for k in PATTERNS]
    none = F.array().cast("array<struct<start:int,end:int,by:string>>")
    removed = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "", "[REMOVED]").otherwise(s["action"]).alias("by")))
    every = F.sort_array(F.flatten(F.array(*marks, F.coalesce(removed, none))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), s["by"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

    clean = F.aggregate(every, begin, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    return found.select("doc_id", clean.alias("text"))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    base = F.flatten(F.array(*[listed(k, F.col(k)) for k in PATTERNS]))
    terms = F.coalesce(listed("term", F.col("terms")), F.array().cast("array<string>"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


#: The contract's patterns, as they are.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PLACED = " UNION ALL ".join(
    f"SELECT r, '{kind}' AS kind, {i} AS o, regexp_extract_all(text, '{p}') AS found, regexp_split_to_array(text, '{p}') AS gaps FROM docs" for i, (kind, p) in enumerate(_PLAIN.items())
)
_OUTSIDE = "text"
for _p in (_PLAIN["email"], _PLAIN["ip"], r"[0-9]([\x20-]?[0-9]){15,}", _PLAIN["phone"]):
    _OUTSIDE = f"regexp_replace({_OUTSIDE}, '{_p}', ' ', 'g')"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"

ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
placed AS ({_PLACED}),
matched AS (SELECT r, kind, o, unnest(found) AS value, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM placed),
spans AS (
    SELECT r, kind, o, value, "end" - length(value) AS start, "end", {_DIGITS} AS digits
    FROM (SELECT *, (sum(length(gap) + length(value)) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT AS "end" FROM matched)),
base AS (
    SELECT * FROM spans WHERE CASE kind
        WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INTEGER), 0) > 255)) = 0
        WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
            CASE WHEN i % 2 = 0 THEN substr(digits, length(digits) - i, 1)::INTEGER
                WHEN substr(digits, length(digits) - i, 1)::INTEGER > 4 THEN 2 * substr(digits, length(digits) - i, 1)::INTEGER - 9
                ELSE 2 * substr(digits, length(digits) - i, 1)::INTEGER END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15 ELSE true END),
held AS (SELECT text, count(*) AS n FROM docs WHERE r IN (SELECT r FROM base) GROUP BY text),
seen AS (SELECT DISTINCT text, n, kind || ':' || lower(value) AS entity FROM base JOIN docs USING (r) JOIN held USING (text)),
protected AS (SELECT entity, sum(n) AS n_c FROM seen GROUP BY entity HAVING count(*) >= {SUPPORT}),
words AS (
    SELECT r, text, unnest(list_distinct(regexp_extract_all(lower(CASE WHEN regexp_matches(text, '[0-9@]') THEN {_OUTSIDE} ELSE text END), '[\p{{L}}\p{{N}}]+'))) AS w FROM docs),
terms AS (SELECT DISTINCT r, text, term FROM (SELECT r, text, w AS term FROM words UNION ALL SELECT r, text, left(w, {STEM}) || '*' FROM words)),
frequency AS (SELECT term, count(*) AS n_t FROM terms GROUP BY term),
together AS (
    SELECT entity, n_c, term, sum(n) AS n_ct
    FROM protected JOIN seen USING (entity) JOIN (SELECT DISTINCT text, term FROM terms) USING (text) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
disclosing AS (
    SELECT entity, term FROM together JOIN frequency USING (term), (SELECT count(*)::DOUBLE AS rows FROM docs)
    WHERE ln(rows / n_c) > 0 AND ln(rows * n_ct / (n_c * n_t)) >= {DISCLOSURE} * ln(rows / n_c) - 1e-9),
hits AS (SELECT DISTINCT text, term FROM disclosing JOIN seen USING (entity) JOIN terms USING (text, term)),
parts AS (
    SELECT r, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS found, regexp_split_to_array(text, '[\p{{L}}\p{{N}}]+') AS gaps, text FROM docs WHERE text IN (SELECT text FROM hits)),
word_spans AS (
    SELECT r, text, value, "end" - length(value) AS start, "end" FROM (
        SELECT *, (sum(length(gap) + length(value)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS "end" FROM (
            SELECT r, text, unnest(found) AS value, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM parts))),
added AS (
    SELECT r, start, "end" FROM word_spans AS w JOIN hits AS h ON h.text = w.text AND h.term = lower(w.value)
    WHERE NOT EXISTS (SELECT 1 FROM base AS b WHERE b.r = w.r AND b.start < w."end" AND w.start < b."end")),
every AS (
    SELECT r, kind, o, start, "end" FROM base UNION ALL SELECT r, 'term', {len(_PLAIN)}, start, "end" FROM added)
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PLAIN)},
    sha256(coalesce(string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY o, start) FILTER (kind <> 'term'), '')) AS base_sha256,
    coalesce(string_agg(concat_ws(':', kind, start, "end"), ',' ORDER BY o, start) FILTER (kind IS NOT NULL), '') AS spans
FROM docs LEFT JOIN every USING (r) GROUP BY r
"""
