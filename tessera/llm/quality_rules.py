"""Quality rules: fixed base rules, then divergence from language references.

A language reference is the histogram of character classes and of common words over all
documents that name the language.  A document is kept when, for some reference, the
Jensen-Shannon distance of both its histograms is small.  Everything is DataFrame code; the
measures of a document are taken within its row, so nothing but the references is shuffled.

The languages in COMMON have fixed common words.  Any other language has its own reference, with its most
frequent words, for the documents that name it; the verdict on all others doesn't depend on it.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, bind, dealt, fresh, named, plain_names, table, words, written

SYMBOLS = "#*$%&|<>"
#: Other ASCII marks, by rule.
MARKS = "".join(c for c in string.punctuation if c not in SYMBOLS)
#: Frequent words of the languages that have a reference.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his are this at from or have an they which one you had but we has were there been their if would who all will can more when no so".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou cette mais comme nous sa on ont elle leur tout deux même été ces".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue".split(),
}
VOCABULARY = sorted(set().union(*COMMON.values()))
#: How a listed word may be written: small, with a capital, all capitals, and one mark after it.
ENDS = ".,;:!?"
SPELLED = sorted({f for v in VOCABULARY for f in (v, v.capitalize(), v.upper())})
FORMS = [f + e for f in SPELLED for e in ("", *ENDS)]
#: As many frequent words of a language without a list make its reference.
MOST_FREQUENT = 50
CLASSES = ("upper", "digit", "symbol", "mark", "other", "wide")
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: Below these lengths a histogram says too little and isn't judged.
GUARD_WORDS, GUARD_CHARS = 80, 240
#: Distances that pass; by words, a text of n words may be further away by chance, about as 1 / sqrt(n).
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, CHANCE = 0.32, 0.22, 1.4


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(w: Column, n: Column, window: int = WINDOW) -> Column:
    """Words in windows that the text holds twice or more.

    Each window is hashed to 64 bits.  Only where two are equal, the hashes are sorted along with
    their places and neighbours compared.
    """
    found = bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _covered(h, F.size(h), window))
    return F.when(n > window, found).otherwise(F.lit(0)).cast("long")


def _covered(hashes: Column, n: Column, window: int) -> Column:
    lanes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))

    def marked(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    placed = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bind(lanes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(bind(placed(g), lambda s: bind(marked(s), total))))


def measure(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with the measures of each text, and the names of the added columns."""
    name = {k: fresh(docs, f"qr_{k}") for k in ("text", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "common", "classes", "counts")}
    t, w = F.col(name["text"]), F.col(name["words"])
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, SPACE) > 0)
    out = docs.withColumn(name["text"], F.coalesce(F.col(text), F.lit(""))).withColumn(name["words"], words(t)).withColumn(name["n_words"], F.size(w).cast("long"))
    out = out.withColumn(name["classes"], F.translate(t, string.ascii_lowercase, ""))
    r = F.col(name["classes"])  # what is not a small letter: short, and all the counts below come from it
    some = lambda chars: (F.length(r) - _without(r, chars)).cast("long")
    out = out.withColumns({
        name["word_chars"]: F.length(t).cast("long") - some(SPACE),
        name["n_symbols"]: some(SYMBOLS),
        name["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        name["n_repeat_words"]: repeated_words(w, F.col(name["n_words"]).cast("int")),
        name["common"]: F.transform(F.filter(w, lambda x: x.isin(*FORMS)), lambda x: F.lower(F.rtrim(x, F.lit(ENDS)))),
        name["classes"]: F.array(some(string.ascii_uppercase), some(string.digits), some(SYMBOLS), some(MARKS), (F.octet_length(t) - F.length(t)).cast("long")),
    })
    c, chars = F.col(name["classes"]), F.col(name["word_chars"])
    rest = chars - sum((F.get(c, F.lit(i)) for i in range(4)), F.lit(0).cast("long"))
    out = out.withColumn(name["classes"], F.concat(F.slice(c, 1, 4), F.array(rest), F.slice(c, 5, 1)))
    out = out.withColumn(name["counts"], bind(F.col(name["common"]), _counts))
    return out, name


def _counts(x: Column) -> Column:
    return F.transform(F.array_distinct(x), lambda v: F.struct(v.alias("w"), (F.size(x) - F.size(F.array_remove(x, v))).cast("long").alias("c")))


def _plain(word: Column) -> Column:
    """A word in small letters without the one mark after it."""
    return F.regexp_replace(F.lower(word), f"[{ENDS}]$", "")


def _unlisted(lang: str) -> Column:
    return F.col(lang).isNotNull() & ~F.col(lang).isin(*COMMON)


def frequent_words(docs: DataFrame, text: str, lang: str, own: str, listed: str) -> DataFrame:
    """own: every language of docs without a list in COMMON; listed: its most frequent words, over all documents that name it."""
    each = docs.where(_unlisted(lang)).select(F.col(lang).alias(own), F.explode(words(F.col(text))).alias("w"))
    counts = each.groupBy(own, _plain(F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("c")).where("w <> ''")
    # Spark cuts each task's rows to the most frequent ones before it deals them out by language
    best = counts.withColumn("k", F.row_number().over(W.partitionBy(own).orderBy(F.desc("c"), "w"))).where(F.col("k") <= MOST_FREQUENT)
    return written(best.groupBy(own).agg(F.collect_list("w").alias(listed)), "frequent")


def own_references(measured: DataFrame, name: dict[str, str], own: str, counts: str, reference: str) -> DataFrame:
    """own, reference (classes, shares, other) of every language without a list, as `references` has them for the others."""
    c = F.col(name["classes"])
    parts = [F.struct(F.lit(f" {k}").alias("w"), F.get(c, F.lit(i)).alias("c")) for i, k in enumerate(CLASSES)]
    parts.append(F.struct(F.lit(" n").alias("w"), F.col(name["n_words"]).alias("c")))
    rows = measured.where(F.col(own).isNotNull()).select(own, F.explode(F.concat(F.col(counts), F.array(*parts))).alias("s"))
    sums = rows.groupBy(own, F.col("s.w").alias("w")).agg(F.sum("s.c").alias("c"))
    # a language has at most MOST_FREQUENT words here, and the measures, whose names begin with a space
    m = sums.groupBy(own).agg(F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("m")).select(own, "m", F.col("m")[" n"].alias("n"), F.array(*[F.col("m")[f" {k}"] for k in CLASSES]).alias("k")).where("n > 0")
    total = F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x)
    m = m.select(own, F.transform("k", lambda x: x / total).alias("classes"), F.transform_values(F.map_filter("m", lambda w, _: ~w.startswith(" ")), lambda _, x: x / F.col("n")).alias("shares"))
    other = F.greatest(F.lit(0.0), 1.0 - F.aggregate(F.map_values("shares"), F.lit(0.0), lambda a, x: a + x))
    return written(m.select(own, F.struct("classes", "shares", other.alias("other")).alias(reference)), "references")


def references(measured: DataFrame, name: dict[str, str], lang: str = "lang") -> dict[str, tuple[list[float], dict[str, float], float]]:
    """Histograms of the languages in COMMON, over all documents: classes, words, and the share of other words.

    At most one row per language and listed word comes back to the driver, whatever the corpus.
    """
    c = F.col(name["classes"])
    parts = [F.struct(F.lit(f" {k}").alias("w"), F.get(c, F.lit(i)).alias("c")) for i, k in enumerate(CLASSES)]
    parts.append(F.struct(F.lit(" n").alias("w"), F.col(name["n_words"]).alias("c")))
    rows = measured.where(F.col(lang).isin(*COMMON)).select(F.col(lang).alias("lang"), F.explode(F.concat(F.col(name["counts"]), F.array(*parts))).alias("s"))
    sums: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("lang", "s.w").agg(F.sum("s.c").alias("c")).collect():
        sums.setdefault(r["lang"], {})[r["w"]] = r["c"]
    found = {}
    for k, x in sums.items():
        n, classes = x[" n"], [x[f" {c}"] for c in CLASSES]
        if n:
            shares = {v: x[v] / n for v in VOCABULARY if v in x}
            found[k] = ([v / sum(classes) for v in classes], shares, max(0.0, 1 - sum(shares.values())))
    return found


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence, in bits."""
    side = lambda a, b: F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(0.0)
    return (side(p, q) + side(q, p)) / 2.0


def distances(name: dict[str, str], reference) -> tuple[Column, Column]:
    """Jensen-Shannon distances of a row's classes and common words to a reference, of numbers or of columns."""
    classes, shares, other = reference
    c, n = F.col(name["classes"]), F.greatest(F.col(name["n_words"]), F.lit(1)).cast("double")
    total = F.greatest(F.col(name["word_chars"]) + F.get(c, F.lit(len(CLASSES) - 1)), F.lit(1))
    by_class = sum((_term(F.get(c, F.lit(i)) / total, F.lit(q)) for i, q in enumerate(classes)), F.lit(0.0))
    if isinstance(shares, Column):
        known, all_shares = shares, F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, x: a + x)
    else:
        known = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.create_map(F.lit(""), F.lit(0.0))
        all_shares = F.lit(sum(shares.values()))
    q = lambda s: F.coalesce(F.element_at(known, s["w"]), F.lit(0.0))
    sums = F.aggregate(F.col(name["counts"]), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")), lambda a, s: F.struct((a["d"] + _term(s["c"] / n, q(s))).alias("d"), (a["p"] + s["c"] / n).alias("p"), (a["q"] + q(s)).alias("q")))
    word = F.get(F.transform(F.array(sums), lambda a: a["d"] + _term(F.greatest(F.lit(0.0), 1.0 - a["p"]), F.lit(other)) + F.greatest(F.lit(0.0), all_shares - a["q"]) / 2.0), F.lit(0))
    return F.sqrt(F.greatest(by_class, F.lit(0.0))), F.sqrt(F.greatest(word, F.lit(0.0)))


def _near(name: dict[str, str], reference) -> Column:
    """Whether both distances to a reference pass."""
    by_class, by_word = distances(name, reference)
    return ((F.col(name["word_chars"]) < GUARD_CHARS) | (by_class <= MAX_CLASS_DISTANCE)) & ((F.col(name["n_words"]) < GUARD_WORDS) | (by_word <= F.lit(MAX_WORD_DISTANCE) + F.lit(CHANCE) / F.sqrt(F.greatest(F.col(name["n_words"]), F.lit(1)).cast("double"))))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", without: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Columns of docs with these names are replaced; those in `without` are left out of the result.  A null or empty text has no words and fails
    the base rules.  A text is compared with the references of the languages in COMMON, one that names
    another language also with that language's; a null language adds to no reference.  Where there
    is none (an empty table), the base rules decide.  Texts under
    the guards aren't judged by the histogram in question.  Repeated rows are judged alike.
    """
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs, of_name = plain_names(docs.drop(*[c for c in docs.columns if c.lower() in (*shown, "base_failed", "kept")]))
    text, lang, without = of_name[text], of_name[lang], tuple(of_name.get(c, c) for c in without)
    given, own = docs, None
    if docs.where(_unlisted(lang)).select(lang).take(1):
        own, listed, counts, reference = (fresh(docs, f"qo_{k}") for k in ("lang", "listed", "counts", "reference"))
        docs = docs.join(frequent_words(docs, text, lang, own, listed), F.col(lang) == F.col(own), "left")
    measured, name = measure(dealt(docs), text)
    if own:
        spelled = F.filter(F.transform(F.col(name["words"]), _plain), lambda v: F.array_contains(F.col(listed), v))
        measured = measured.withColumn(counts, F.when(F.col(own).isNotNull(), bind(spelled, _counts))).drop(listed)
    # both the references and the verdicts need the measures; what they are made of isn't kept
    measured = written(measured.drop(name["text"], name["words"], name["common"], *without), "measured")
    docs = given.drop(*without)
    kept = F.lit(False)
    found = references(measured, name, lang)
    for _, reference_ in sorted(found.items()):
        kept |= _near(name, reference_)
    kept = kept if found else F.lit(True)
    if own:
        of = own_references(measured, name, own, counts, reference)
        measured = measured.join(of.withColumnRenamed(own, f"{own}_of"), F.col(own) == F.col(f"{own}_of"), "left")
        r = F.col(reference)
        near = _near(name | {"counts": counts}, ([F.get(r["classes"], F.lit(i)) for i in range(len(CLASSES))], r["shares"], r["other"]))
        kept = F.when(F.col(own).isNull(), kept).when(r.isNull(), F.lit(True)).otherwise((kept if found else F.lit(False)) | near)
    out = measured.select(*docs.columns, *[F.col(name[c]).alias(c) for c in shown], kept.alias("kept"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return named(out.select(*docs.columns, *shown, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept")), of_name)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, without=("text",)).drop("lang")


QUERIES = {"op10_quality_rules": op10_quality_rules}


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(quote(v) for v in SPELLED)
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    some = lambda chars: f"length(t) - length(translate(t, {quote(chars)}, ''))"
    term = lambda p, q: f"((CASE WHEN {p} > 0 THEN {p} * log2(2.0::DOUBLE * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2.0::DOUBLE * {q} / ({p} + {q})) ELSE 0 END) / 2.0::DOUBLE)"
    return rf"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, length(translate(t, {space}, '')) AS word_chars, {some(SYMBOLS)} AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {space}, '')) > 0) AS lines,
        {some(string.ascii_uppercase)} AS c0, {some(string.digits)} AS c1, {some(MARKS)} AS c3, strlen(t) - length(t) AS c5 FROM b),
n AS (SELECT *, len(w) AS n_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_symbols AS c2, word_chars - c0 - c1 - n_symbols - c3 AS c4 FROM m),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) >= 8)),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat FROM (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1), range(8) AS k(j) GROUP BY r),
cw AS (SELECT r, lower(v) AS v, count(*) AS c FROM (SELECT r, regexp_replace(v, '[{ENDS}]$', '') AS v FROM (SELECT r, unnest(w) AS v FROM m)) WHERE v IN ({known}) GROUP BY r, lower(v)),
langs AS (SELECT lang, sum(n_words)::DOUBLE AS n, sum(word_chars + c5)::DOUBLE AS chars, {", ".join(f"sum(c{i})::DOUBLE AS s{i}" for i in range(6))} FROM n WHERE lang IN ({", ".join(quote(x) for x in COMMON)}) GROUP BY lang HAVING sum(n_words) > 0),
q AS (SELECT n.lang, v, sum(c) / any_value(l.n) AS q FROM cw JOIN n USING (r) JOIN langs l ON l.lang = n.lang GROUP BY n.lang, v),
qs AS (SELECT lang, sum(q) AS q FROM q GROUP BY lang),
js AS (SELECT x.r, x.lang, sum(d) + {term("greatest(0, 1 - sum(p))", "any_value(greatest(0, 1 - coalesce(x.qs, 0)))")} + greatest(0, any_value(coalesce(x.qs, 0)) - sum(qv)) / 2 AS d FROM
  (SELECT n.r, l.lang, qs.q AS qs, coalesce(cw.c / n.n_words::DOUBLE, 0) AS p, CASE WHEN cw.c IS NULL THEN 0 ELSE coalesce(q.q, 0) END AS qv, CASE WHEN cw.c IS NULL THEN 0 ELSE {term("(cw.c / n.n_words::DOUBLE)", "coalesce(q.q, 0)")} END AS d
   FROM n CROSS JOIN langs l LEFT JOIN qs ON qs.lang = l.lang LEFT JOIN cw ON cw.r = n.r LEFT JOIN q ON q.lang = l.lang AND q.v = cw.v WHERE n.n_words > 0) x GROUP BY x.r, x.lang),
ok AS (SELECT n.r, bool_or((n.word_chars < {GUARD_CHARS} OR sqrt({" + ".join(term(f"(c{i} / (word_chars + c5)::DOUBLE)", f"(s{i} / chars)") for i in range(6))}) <= {MAX_CLASS_DISTANCE}) AND (n.n_words < {GUARD_WORDS} OR sqrt(greatest(js.d, 0)) <= {MAX_WORD_DISTANCE}::DOUBLE + {CHANCE}::DOUBLE / sqrt(n.n_words::DOUBLE))) AS ok
  FROM n JOIN js USING (r) JOIN langs l ON l.lang = js.lang GROUP BY n.r),
f AS (SELECT n.*, coalesce(n_repeat, 0) AS n_repeat_words, n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat, 0) > {MAX_REPEATED} * n_words AS base_failed, coalesce(ok, true) AS ok FROM n LEFT JOIN rep USING (r) LEFT JOIN ok USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM f"""


ORACLES = {"op10_quality_rules": _oracle()}
