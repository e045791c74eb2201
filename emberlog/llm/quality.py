"""Quality rules with risk-controlled thresholds.

Every rule is a ratio of two counts of a document ("higher is worse") with a ladder of ``LEVELS`` cutoffs, from ones that hardly any text
reaches down to such as are in common use. Level j takes the j-th cutoff of every rule and rejects a document that is above one of them, so
each level rejects all that the one before it does. The number of levels that reject a document is its severity.

Documents that people labelled good and that pass the base rules form the holdout; each counts as one trial, however many rows or labels it has. In a stratum (language)
with n of them, of which level j rejects k, the level is certified if the exact binomial probability of k or fewer at a true false rejection
rate of ``alpha`` is at most ``delta / units`` (Clopper-Pearson's bound). Levels are tested in their fixed order from the most lenient until one
fails, which needs no correction; ``units``, the number of strata tested, is Bonferroni's correction over strata. The last certified
level is used; where none is, no rule rejects anything. So with probability ``1 - delta`` no tested stratum loses more than ``alpha`` of its good
documents to all rules together.

A stratum is tested by itself if its good labels suffice to certify anything (``labels_needed``). All others, those without any label too, share
one more unit: the good labels of these thin strata together or, if even those are too few, all good labels. For thin strata the bound
then holds for the unit as a whole, not for each. Which strata share it depends on their numbers of labels only.

All of it is DataFrame expressions. Ratios are compared as integers (1000 * a > cutoff * b), so no rounding decides.

Defined cases: a null text has no words (and fails the base rule, as any text under ``MIN_WORDS`` words does); a null language is
the stratum ''; an empty table, or too few good labels in all, gives base verdicts only; repeated rows are judged one by one, and as a trial
a repeated id has the severity of its worst row and the first stratum by name; an id labelled both ways is good; columns of the
input that clash with the counts' names are left alone because only named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.runtime import SPACE_CLASS, SPACES, materialize

MIN_WORDS = 50
#: Share of good documents, in each stratum, that all rules together may reject, and the chance of breaking that.
ALPHA, DELTA = 0.02, 0.05
LEVELS = 8
SYMBOLS = "#*$%&|<>"
#: Rule: counted, out of, cutoffs in thousandths from lenient to strict.
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (400, 300, 250, 200, 150, 100, 70, 50)),
    "repeats": ("n_repeat_words", "n_words", (500, 450, 400, 350, 300, 270, 240, 200)),
    "dup_lines": ("n_dup_lines", "n_lines", (600, 500, 450, 400, 380, 360, 330, 300)),
    "upper": ("n_upper", "word_chars", (700, 600, 500, 450, 400, 350, 300, 250)),
    "exclaims": ("n_exclaims", "n_words", (900, 700, 500, 400, 300, 200, 150, 100)),
}
BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE_COUNTS, "n_lines", "n_upper", "n_exclaims"]


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, given the hash of each window of three words.

    Windows sorted by hash stand next to their equals. What repeats is put in page order again, and each window adds
    the words that the one before it does not cover.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    # transform() over a one-element array binds the sorted array to a name, so that it is sorted once
    starts = F.transform(F.array(ordered), lambda s: F.transform(F.filter(s, lambda x, j: same(s, j - 1, x) | same(s, j + 1, x)), lambda x: x["i"]))
    first = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"))
    covered = F.aggregate(F.sort_array(F.get(starts, F.lit(0))), first, step, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``COUNTS`` of the whole text, as longs, under ``prefix``."""
    body, own = F.coalesce(F.col(text), F.lit("")), docs.columns
    trimmed = F.btrim(body, F.lit(SPACES))
    out = docs.withColumns({"_q_body": body, "_q_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))})
    words, body = F.col("_q_words"), F.col("_q_body")
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    out = out.withColumns(
        {
            "_q_n": F.size(words),
            "_q_windows": F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)).otherwise(F.array().cast("array<bigint>")),
            "_q_lines": F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        }
    )
    counts = {
        "n_words": F.col("_q_n"),
        "word_chars": _without(body, SPACES),
        "n_symbols": F.char_length(body) - _without(body, SYMBOLS),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": _repeat_words(F.col("_q_windows")),
        "n_lines": F.size("_q_lines"),
        "n_upper": F.char_length(body) - F.char_length(F.regexp_replace(body, r"\p{Lu}+", "")),
        "n_exclaims": F.char_length(body) - _without(body, "!"),
    }
    return out.select(*own, *[counts[c].cast("bigint").alias(prefix + c) for c in COUNTS])


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


def above(rule: str, cutoff: Column, prefix: str = "") -> Column:
    a, b, _ = RULES[rule]
    return 1000 * F.col(prefix + a) > cutoff * F.col(prefix + b)


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, carried back to x > 0; good to about 1e-13."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    back = F.log(x)
    for j in range(1, 8):
        back = back + F.log(x + j)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, rate); 1 where k is not below the mean (such a k certifies nothing).

    The largest term comes from log gammas. Terms below it fall faster than a geometric series, and those beyond
    60 standard deviations are under the precision of a double.
    """
    nd, kd = n.cast("double"), k.cast("double")
    log_top = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * math.log(rate) + (nd - kd) * math.log1p(-rate)
    terms = F.least(kd, 200 + 60 * F.sqrt(nd * rate)).cast("int")
    odds = (1 - rate) / rate
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] * (kd - j + 1) / (nd - kd + j) * odds
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    ratio = F.when(terms < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda a: a["s"]))
    return F.when(kd >= nd * rate, F.lit(1.0)).otherwise(F.exp(log_top) * ratio)


def severity(prefix: str = "") -> Column:
    """How many levels reject a document: the most cutoffs that it exceeds of one rule."""
    return F.greatest(*[sum((F.when(above(rule, F.lit(c), prefix), 1).otherwise(0) for c in ladder), F.lit(0)) for rule, (_, _, ladder) in RULES.items()])


def labels_needed(n_units: Column, alpha: float = ALPHA, delta: float = DELTA) -> Column:
    """Good labels without which no level can be certified, even with no good document above it."""
    return F.ceil(F.log(F.lit(delta) / n_units) / math.log1p(-alpha))


def certified(counts: DataFrame, labels: DataFrame, stratum: Column, alpha: float = ALPHA, delta: float = DELTA, prefix: str = "") -> DataFrame:
    """A row for each unit: stratum (null: the shared unit), its number of good labels and the certified level (null: none).

    ``counts`` has doc_id and the counts; ``labels`` has doc_id and quality (1 is good). Only labelled rows are shuffled, and they are
    added up before the shuffle by stratum.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_good")).distinct()
    held = counts.where(~base_failed(prefix)).select(F.col("doc_id").alias("_id"), stratum.alias("stratum"), severity(prefix).alias("severity")).join(good, F.col("_id") == F.col("_good"))
    trials = held.groupBy("_id").agg(F.min("stratum").alias("stratum"), F.max("severity").alias("severity"))
    ks = [f"k{j}" for j in range(1, LEVELS + 1)]
    sums = trials.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("severity") > LEVELS - j, 1)).alias(k) for j, k in enumerate(ks, 1)])
    # from here on there is a row for each stratum
    whole = Window.partitionBy(F.lit(0))
    sums = sums.withColumn("n_units", 1 + F.count(F.when(F.col("n") >= labels_needed(F.lit(1), alpha, delta), 1)).over(whole))
    needed = labels_needed(F.col("n_units"), alpha, delta)
    thin = lambda c: F.sum(F.when(F.col("n") < needed, F.col(c)).otherwise(0)).over(whole)
    shared = [F.when(thin("n") >= needed, thin(c)).otherwise(F.sum(c).over(whole)).alias(c) for c in ("n", *ks)]
    first = F.row_number().over(whole.orderBy("stratum")) == 1
    own = F.when(F.col("n") >= needed, F.struct("stratum", "n", *ks))
    rest = F.when(first, F.struct(F.lit(None).cast("string").alias("stratum"), *shared))
    units = sums.select("n_units", own.alias("own"), rest.alias("rest"))
    units = units.select("n_units", F.explode(F.array_compact(F.array("own", "rest"))).alias("u")).select("n_units", "u.*")
    flat = units.select("stratum", "n", "n_units", F.posexplode(F.array(*ks)).alias("j", "k"))
    passed = F.when(binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / F.col("n_units"), F.col("j") + 1)
    return flat.groupBy("stratum").agg(F.first("n").alias("n_good"), F.max(passed).alias("level"))


def judge(counts: DataFrame, cutoffs: DataFrame, stratum: Column, prefix: str = "") -> DataFrame:
    """``counts`` with ``base_failed``, ``kept`` and ``rejected_by`` (names of rules).

    Spark broadcasts ``cutoffs`` if its files are below the session's threshold; it has a row for each stratum.
    """
    own, shared = counts.columns, cutoffs.where(F.col("stratum").isNull()).first()
    tested = cutoffs.where(F.col("stratum").isNotNull()).select(F.col("stratum").alias("_tested"), F.coalesce("level", F.lit(0)).alias("_level"))
    out = counts.withColumn("_stratum", stratum).join(tested, F.col("_stratum") == F.col("_tested"), "left")
    level = F.coalesce(F.col("_level"), F.lit(shared["level"] or 0 if shared else 0))
    hits = F.array_compact(F.array(*[F.when(above(rule, F.get(F.array(*map(F.lit, ladder)), level - 1), prefix), F.lit(rule)) for rule, (_, _, ladder) in RULES.items()]))
    out = out.select(*own, base_failed(prefix).alias("base_failed"), hits.alias("rejected_by"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The verdict on every row of ``docs`` (doc_id, text, lang). The counts are made once and written to the shared folder."""
    stratum = F.coalesce(F.col("lang"), F.lit(""))
    counts = materialize(with_counts(docs.select("doc_id", F.col(text).alias("text"), "lang")).drop("text"), "quality-counts")
    cutoffs = materialize(certified(counts, labels, stratum, alpha, delta), "quality-cutoffs")
    return judge(counts, cutoffs, stratum).select("doc_id", *BASE_COUNTS, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only. Texts and counts are written once.

    The columns of ``docs`` travel in one struct, so none of their names can clash.
    """
    stratum = F.coalesce(F.col("_q_doc.lang"), F.lit(""))
    packed = docs.select(F.struct(*docs.columns).alias("_q_doc"))
    counted = materialize(with_counts(packed, f"_q_doc.{text}"), "quality-documents")
    cutoffs = materialize(certified(counted.withColumn("doc_id", F.col("_q_doc.doc_id")), labels, stratum), "quality-cutoffs")
    return judge(counted, cutoffs, stratum).where("kept").select("_q_doc.*")


#: Common tables of the SQL form: counts, cutoffs and verdicts of ``documents``.
def sql_tables() -> str:
    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    case = lambda rule, c: f"1000 * {RULES[rule][0]} > {c} * {RULES[rule][1]}"
    exceeded = [" + ".join(f"CASE WHEN {case(r, c)} THEN 1 ELSE 0 END" for c in ladder) for r, (_, _, ladder) in RULES.items()]
    need = lambda units: f"ceil(ln({DELTA}::DOUBLE / {units}) / ln(1 - {ALPHA}::DOUBLE))"
    cutoff = lambda r: f"list_extract([{', '.join(map(str, RULES[r][2]))}], nullif(level, 0))"
    return f"""
docw AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS body, {words} AS words, list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM docw WHERE len(words) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS m FROM win) WHERE m > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
cnt AS (SELECT docw.doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(body) - length(regexp_replace(body, '\\p{{Lu}}+', '', 'g')) AS n_upper, length(body) - length(replace(body, '!', '')) AS n_exclaims
  FROM docw LEFT JOIN cov ON docw.rid = cov.rid),
trials AS (SELECT doc_id, min(coalesce(lang, '')) AS stratum, max(greatest({', '.join(exceeded)})) AS severity FROM cnt WHERE NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id),
hist AS (SELECT stratum, j, count(*) AS n, count(CASE WHEN severity > {LEVELS} - j THEN 1 END) AS k FROM trials, (SELECT unnest(range(1, {LEVELS + 1})) AS j) GROUP BY stratum, j),
counted AS (SELECT *, 1 + (SELECT count(*) FROM hist WHERE j = 1 AND n >= {need(1)}) AS n_units FROM hist),
marked AS (SELECT *, n >= {need('n_units')} AS own FROM counted),
pool AS (SELECT j, n_units, sum(CASE WHEN own THEN 0 ELSE n END) AS pn, sum(CASE WHEN own THEN 0 ELSE k END) AS pk, sum(n) AS an, sum(k) AS ak FROM marked GROUP BY j, n_units),
units AS (SELECT stratum, j, n, k, n_units FROM marked WHERE own UNION ALL
  SELECT NULL, j, CAST(CASE WHEN pn >= {need('n_units')} THEN pn ELSE an END AS BIGINT), CAST(CASE WHEN pn >= {need('n_units')} THEN pk ELSE ak END AS BIGINT), n_units FROM pool),
tails AS (SELECT stratum, j, n_units, CASE WHEN k >= n * {ALPHA} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS p FROM units),
cuts AS (SELECT stratum, coalesce(max(CASE WHEN p <= {DELTA} / n_units THEN j END), 0) AS level FROM tails GROUP BY stratum),
levelled AS (SELECT cnt.*, CASE WHEN cuts.stratum IS NOT NULL THEN level ELSE coalesce((SELECT level FROM cuts WHERE stratum IS NULL), 0) END AS level FROM cnt LEFT JOIN cuts ON coalesce(lang, '') = cuts.stratum),
verdict AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  list_filter([{', '.join(f"CASE WHEN {case(r, cutoff(r))} THEN '{r}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS rejected_by FROM levelled)"""


def oracle_sql() -> str:
    return f"WITH {sql_tables()}\nSELECT doc_id, {', '.join(BASE_COUNTS)}, base_failed, NOT base_failed AND len(rejected_by) = 0 AS kept, array_to_string(rejected_by, ',') AS rejected_by FROM verdict"
