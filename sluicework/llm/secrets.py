"""Secret scans: candidates by pattern, false positives removed by a random forest (DataFrame functions only).

Candidates are strings with a digit or a known prefix, values assigned to a telling name, bearer tokens, passwords of
URLs and private key blocks, each to its end. Each has features:
length, transitions between character classes, share of its letters that are dictionary words, path marks, and the
words beside it (``SPAN`` characters before, ``BEHIND`` after). The forest learns from labelled findings: a table of them, where the
caller has one, else those whose format and place settle what they are. That the value is assigned to a telling name is
what such labels rest on, so it is no feature. At most ``TRAIN_ROWS`` of them (smallest hash first) are used; everything else
covers all rows. The dictionary is the ``WORDS`` most frequent words of all texts. The trained trees become one SQL
expression, so texts are scanned, scored and redacted in one pass without a shuffle.

Cases: null or empty text -> no finding; a very long text is scanned whole, in time that grows with its length; a value found
twice in a text is one finding, at the first of these places where no letter or digit touches it (else at the first of them), and redacted
everywhere, which takes one pass over the text for each of its secrets; no labelled finding
of one kind -> the format rule decides alone; words that tie for the dictionary are taken in their order; repeated rows give
repeated findings; an empty table gives no finding; other columns are kept by ``redact`` whatever their names, and by ``scan``
but for one of the name ``out``, which is replaced.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import quoted

TRAIN_ROWS, WORDS, TREES, TREE_DEPTH = 20_000, 1_000, 15, 5
SPAN, BEHIND, LEAST, CUT = 48, 16, 8, 1024
MASK = "[REDACTED]"
PLACED = "array<struct<value: string, start: bigint>>"

_KEYED = r"""(?i)(?<![\p{L}0-9])(?:[a-z]+[_-])?(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s*+[=:]\s*+["']?"""
# Dots join the parts of a token, but not those of a number or an address of numbers.
_WITH_DIGIT = r"(?<![A-Za-z0-9+/_.@-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|[0-9]++(?=(?:\.[0-9]++)*+(?!\.?[A-Za-z0-9+/_=-]))|(?:[A-Za-z_+/-]++\.)*+[A-Za-z_+/-]*+[0-9][A-Za-z0-9+/_=-]*+(?:\.[A-Za-z0-9+/_=-]++)*+)"
# Quoted values end at their quote, others at white space; a quote that is never closed ends at white space or any quote.
_ASSIGNED = _KEYED + r"""((?<=")[^"\r\n]{6,}(?=")|(?<=')[^'\r\n]{6,}(?=')|(?<!["'])[^\s"']\S{5,}|(?<=["'])[^\s"']{6,})"""
_BEARER = r"(?i)(?<![\p{L}0-9])bearer\s++([A-Za-z0-9._~+/=-]{8,})"
_URL_USER = r"""(?<![\w.+%-])(?!mailto:)[\w.+%-]*+:([^\s/@"']{6,})@(?=[A-Za-z0-9])"""
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\s]*+)"
FEATURES = [
    "length", "transitions", "digit_share", "upper_share", "hex_share", "distinct_share", "dictionary", "path_marks", "path_before", "keyword_before", "quoted", "number_words"
]


def _bound(value: Column, use) -> Column:
    """``use(value)``, the value being worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _between(array: Column, first: Column, last: Column) -> Column:
    """Elements ``first`` to ``last``, from 0. A slice would copy the whole array first."""
    return F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda j: F.get(array, j))


def _before_each(numbers: Column, width: int = 32) -> Column:
    """What the elements before each one of an array<long> come to: sums of blocks, and of blocks of blocks, keep it near linear."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    last = lambda a: F.floor((F.size(a) - 1) / width).cast("int")
    cut = lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda b: _between(a, b * width, F.least(b * width + width, F.size(a)) - 1))

    def all_blocks(blocks: Column, upper: Column, tops: Column) -> Column:
        def of_block(block: Column, b: Column) -> Column:
            over = F.floor(b / width).cast("int")
            base = total(F.slice(tops, F.lit(1), over)) + total(F.slice(F.get(upper, over), F.lit(1), b % width))
            return _bound(base, lambda x: F.transform(block, lambda _, e: x + total(F.slice(block, F.lit(1), e))))

        return F.flatten(F.transform(blocks, of_block))

    above = lambda blocks: _bound(F.transform(blocks, total), cut)
    by_block = lambda blocks: _bound(above(blocks), lambda upper: _bound(F.transform(upper, total), lambda tops: all_blocks(blocks, upper, tops)))
    return _bound(numbers, lambda n: F.when(F.size(n) > 0, _bound(cut(n), by_block)).otherwise(n))


def _matches(text: Column, pattern: str, group: int, after_value: int, least: int) -> Column:
    """array<struct<value, start>> of the matches of a pattern in their order; a value ends ``after_value`` characters before
    its match does. The text is cut at its matches, and places are what the pieces before come to."""
    p = F.lit(pattern)
    value = lambda whole: whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    parts = lambda whole: F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), value(whole).alias("value"))
    lengths = lambda m: F.transform(m["gaps"], lambda g, i: (F.length(g) + F.coalesce(F.length(F.get(m["whole"], i)), F.lit(0))).cast("long"))

    def placed(m: Column, starts: Column) -> Column:
        end = lambda i: F.get(starts, i + 1) - after_value
        rows = F.transform(m["value"], lambda v, i: F.struct(v.alias("value"), (end(i) - F.length(v) + 1).alias("start")))
        return F.filter(rows, lambda x: F.length(x["value"]) >= least)

    cut = lambda whole: _bound(parts(whole), lambda m: _bound(_before_each(lengths(m)), lambda starts: placed(m, starts)))
    # Most texts have no match that is long enough, and are not cut.
    some = lambda whole: F.when(F.exists(whole, lambda x: F.length(x) >= least), cut(whole)).otherwise(F.array().cast(PLACED))
    return _bound(F.regexp_extract_all(text, p, F.lit(0)), some)


def _around(blocks: Column, start: Column, length: Column) -> tuple[Column, Column]:
    """What stands before and after a stretch of a text that is cut into ``blocks``, without a walk through the text."""

    def at(first: Column, n: Column) -> Column:
        b = F.floor((first - 1) / CUT).cast("int")
        return F.substring(F.concat(F.coalesce(F.get(blocks, b), F.lit("")), F.coalesce(F.get(blocks, b + 1), F.lit(""))), (first - b * CUT).cast("int"), n.cast("int"))

    first = F.greatest(start - SPAN, F.lit(1))
    return at(first, start - first), at(start + length, F.lit(BEHIND))


def candidates(text: Column) -> Column:
    """array<struct<value, start, before, after>> of the distinct candidates of a text, each at the first place where a pattern
    finds it and no letter or digit touches it, or else at the first place where a pattern finds it."""
    none, lower = F.array().cast("array<struct<value: string, start: bigint, before: string, after: string>>"), F.lower(text)
    has = lambda where, *parts: functools.reduce(operator.or_, (F.contains(where, F.lit(p)) for p in parts))
    # What a text must hold for a pattern to match at all, which is quicker to look for than the pattern. Only strings that a
    # digit alone makes candidates have to be longer; the other patterns state their least length.
    kinds = [
        (F.regexp_like(text, F.lit("[0-9]")) | has(text, "AKIA", "ASIA"), _WITH_DIGIT, 0, 0, LEAST),
        (has(text, "=", ":") & has(lower, "passw", "passphrase", "pwd", "secret", "token", "key"), _ASSIGNED, 1, 0, 1),
        (has(lower, "bearer"), _BEARER, 1, 0, 1), (has(text, "@") & has(text, ":"), _URL_USER, 1, 1, 1), (has(text, "-----BEGIN "), _PEM, 0, 0, 1),
    ]
    found = F.concat(*[F.when(needs, _matches(text, *kind)).otherwise(F.array().cast(PLACED)) for needs, *kind in kinds])
    def with_context(x: Column, blocks: Column) -> Column:
        before, after = _around(blocks, x["start"], F.length(x["value"]))
        return F.struct(x["value"].alias("value"), x["start"].alias("start"), before.alias("before"), after.alias("after"))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))
    found = _bound(found, lambda all_: F.when(F.size(all_) > 0, _bound(blocks, lambda b: F.transform(all_, lambda x: with_context(x, b)))).otherwise(none))
    touched = lambda x: F.regexp_like(x["before"], F.lit(r"[\p{L}0-9]$")) | F.regexp_like(x["after"], F.lit(r"^[\p{L}0-9]"))
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["value"].alias("value"), touched(x).alias("touched"), x["start"].alias("start"), x["before"].alias("before"), x["after"].alias("after"))))
    first = lambda rows: F.filter(rows, lambda x, i: (i == 0) | (x["value"] != F.get(rows, i - 1)["value"]))
    kept = F.transform(_bound(ordered, first), lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), x["before"].alias("before"), x["after"].alias("after")))
    return F.coalesce(kept, none)


def _flag(text: Column, pattern: str) -> Column:
    return F.when(F.regexp_like(text, F.lit(pattern)), 1.0).otherwise(0.0)


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def findings(found: Column, words: list[str]) -> Column:
    """array<struct<value, start, label, features...>> of an array of candidates."""
    return F.transform(found, lambda x: _features(x["value"], x["start"], x["before"], x["after"], words))


def finding(value: Column, text: Column, words: list[str]) -> Column:
    """struct<value, start, label, features...> of one value, at its first place that no letter or digit touches, if it has one."""
    alone = F.concat(F.lit(r"(?<![\p{L}0-9])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}0-9])"))
    hit = F.regexp_instr(text, alone)
    start = F.when(hit > 0, hit).otherwise(F.position(value, text)).cast("long")
    first = F.greatest(start - SPAN, F.lit(1))
    around = F.struct(value.alias("value"), start.alias("start"), F.substring(text, first, start - first).alias("before"), F.substring(text, start + F.length(value), F.lit(BEHIND)).alias("after"))
    return findings(F.array(around), words)[0]


def _features(value: Column, start: Column, before: Column, after: Column, words: list[str]) -> Column:
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}{3,}"), F.lit(0))
    known = F.filter(runs, lambda w: F.array_contains(F.array(*map(F.lit, words)).cast("array<string>"), w))
    covered = F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w)) / F.length(value)
    distinct = F.size(F.array_distinct(F.split(value, ""))) / F.length(value)
    assigned = _flag(before, _KEYED + r"$|(?<![\p{L}0-9])bearer\s++$|://[^\s/:@]*:$")
    values = {
        "length": F.least(F.length(value), F.lit(200)).cast("double"),
        "transitions": (F.regexp_count(value, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / F.length(value),
        "digit_share": _share(value, "[0-9]"), "upper_share": _share(value, "[A-Z]"), "hex_share": _share(value, "[0-9a-f]"), "distinct_share": distinct,
        "dictionary": covered, "path_marks": F.regexp_count(value, F.lit(r"[/.\\-]")).cast("double"), "path_before": _flag(before, r"(?:https?:/|[/\\~])[\p{L}0-9_./\\-]*$"),
        "keyword_before": _flag(before, r"(?i)password|passwd|passphrase|pwd|secret|token|key|credential|auth|bearer"),
        "quoted": _flag(before, r"""["']$""") * _flag(after, r"""^["']"""), "number_words": _flag(before, r"(?i)(?:\+|\(|\b(?:tel|phone|fax|no|nr|card|order|id|page|call)\b[.: ]*)[0-9 ()-]*$"),
    }
    issued = F.regexp_like(value, F.lit(r"^(?:AKIA|ASIA)[A-Z2-7]{16}$|^-----BEGIN [A-Z ]*PRIVATE KEY-----"))
    mixed = F.regexp_like(value, F.lit(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=.-]{12,}$"))
    plain = F.regexp_like(value, F.lit(r"^[0-9/_=+-]+$")) | F.regexp_like(value, F.lit(r"^[\p{L}.]+[0-9]{1,4}$")) & (assigned == 0)
    label = F.when(issued | ((assigned == 1) & mixed), 1.0).when(plain, 0.0)
    return F.struct(value.alias("value"), start.alias("start"), label.alias("label"), *[F.coalesce(values[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES])


def dictionary(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent words of 4 to 12 letters."""
    word = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<!\p{L})\p{L}{4,12}+(?!\p{L})"), F.lit(0)))
    top = docs.select(word.alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(WORDS)
    return [r.w for r in top.collect()]


def train(findings: DataFrame) -> list[str] | None:
    """Trees, as text, from labelled rows (label, features...); None if the labels are all alike."""
    sample = findings.where(F.col("label").isNotNull()).orderBy(F.xxhash64("value", "start"), "value").limit(TRAIN_ROWS).coalesce(1)
    sample = sample.select(F.col("label"), *FEATURES).cache()
    try:
        if sample.select("label").distinct().count() < 2:
            return None
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
        model = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=5).fit(rows)
        return [t.toDebugString for t in model.trees]
    finally:
        sample.unpersist()


def _tree(lines: list[str], x: Column, names: list[str]) -> Column:
    """One tree's vote from its printed form: If / Else pairs around Predict lines."""
    line = lines.pop(0).strip()
    if leaf := re.match(r"Predict: (\S+)", line):
        return F.lit(float(leaf[1]))
    at, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    yes = _tree(lines, x, names)
    lines.pop(0)
    no = _tree(lines, x, names)
    return F.when(x[names[int(at)]] <= float(limit), yes).otherwise(no)


def forest_score(x: Column, trees: list[str] | None) -> Column:
    """Share of the trees that call a finding a secret."""
    if trees is None:
        return F.coalesce(x["label"], F.lit(0.0))
    total = F.lit(0.0)
    for text in trees:
        total = total + _tree(text.splitlines()[1:], x, FEATURES)
    return total / len(trees)


def scan(docs: DataFrame, text: str = "text", out: str = "findings", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with an array of struct<value, start, score, is_secret>, one for each candidate.

    ``labelled``: (value, text, label) of findings that someone has judged, label 1 for a secret and 0 for none."""
    words = dictionary(docs, text)
    found = findings(candidates(F.col(quoted(text))), words)
    if labelled is None:
        examples = docs.select(F.explode(found).alias("x")).select("x.*")
    else:
        judged_before = labelled.select(F.col("label").cast("double").alias("judged"), finding(F.col("value"), F.col("text"), words).alias("x")).where("x.value IS NOT NULL")
        examples = judged_before.select("x.*", "judged").withColumn("label", F.col("judged")).drop("judged")
    trees = train(examples)

    def judged(x: Column) -> Column:
        score = forest_score(x, trees)
        return F.struct(x["value"].alias("value"), x["start"].alias("start"), score.alias("score"), (score >= 0.5).alias("is_secret"))

    return docs.withColumn(out, F.transform(found, judged))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret masked; all rows and columns stay, a column n_chars follows the new text."""
    names = docs.columns
    marked = scan(docs, text, "_sw_found")
    secrets = F.filter("_sw_found", lambda x: x["is_secret"])
    longest = F.array_sort(F.transform(secrets, lambda x: F.struct((-F.length(x["value"])).alias("n"), x["value"].alias("v"))))
    body = F.aggregate(longest, F.col(quoted(text)), lambda t, x: F.replace(t, x["v"], F.lit(MASK)))
    masked = marked.withColumn(text, body)
    if "n_chars" in names:
        masked = masked.withColumn("n_chars", F.length(text).cast("long"))
    return masked.select(*[F.col(quoted(c)) for c in names])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All candidates of all texts, with the forest's score and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan(docs).select("doc_id", F.explode("findings").alias("x"))
    return rows.select("doc_id", F.col("x.start").alias("start"), F.length("x.value").alias("length"), F.sha2("x.value", 256).alias("value_sha256"), "x.score", "x.is_secret")
