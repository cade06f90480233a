"""URL filters by a ratio of character language models.

Rules judge the URLs they fit. These verdicts also label the URLs for two
character models, one of accepted and one of rejected URLs: Markov models of
variable order, in which each order backs off to the one below with the weight
of Witten and Bell, down to a uniform distribution over all code points. Other
URLs are judged by the length-normalised difference of the two
log-likelihoods against a threshold calibrated on labelled URLs that trained
neither model.

Contexts and characters are counted exactly, in tables that grow with the
corpus and stay distributed. What is scored is the distinct context and
character: each is joined with its counts once, and URLs are joined with the
results. Logarithms are summed as integers, so sums don't depend on their order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER_STR, ascii_lower, cut, map_rows

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: contexts have 0 to ORDER characters
ORDER = 4
#: characters that a model could predict at all
ALPHABET = 0x110000
#: stands ORDER times before every URL
EDGE = " "
SEED = 4
#: of the labelled URLs, one in so many (by hash) calibrates the threshold
CALIBRATE = 5
#: logarithms are kept in units of 2 ** -UNIT; the threshold is found to within 2 ** -STEP
UNIT, STEP = 32, 8


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``host`` + ``path``) and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def letters(url: str | None) -> str:
    """What the models see of a URL: all after ``://`` (all of it where there is none), A-Z lowered."""
    url = url or ""
    at = url.find("://")
    return (url[at + 3 :] if at >= 0 else url).translate(ASCII_LOWER_STR)


def events(url: str | None) -> list[tuple[str, str]]:
    """Each character after the ORDER characters before it."""
    line = EDGE * ORDER + letters(url)
    return [(line[i - ORDER : i], line[i]) for i in range(ORDER, len(line))]


def count_contexts(labelled: DataFrame) -> DataFrame:
    """``context`` and ``next`` with counts ``n0`` and ``n1`` in rejected and accepted URLs, over all rows of ``labelled`` (``__url``, ``__class`` 0 or 1), for every order."""

    def rows(_, urls, kinds):
        seen = Counter()
        for (url, kind), times in Counter(zip(urls, kinds, strict=True)).items():
            for context, c in events(url):
                for k in range(ORDER + 1):
                    seen[context[k:], c, kind] += times
        for (context, c, kind), n in seen.items():
            yield context, c, n * (kind == 0), n * (kind == 1)

    made = map_rows(labelled, ["__url", "__class"], "context string, next string, n0 bigint, n1 bigint", rows)
    return made.groupBy("context", "next").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def gains(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """``context``, ``next`` and ``gain`` for each of ``wanted`` (distinct, whole contexts): the logarithm of the probability in accepted URLs less that in rejected ones, in units of 2 ** -UNIT.

    A context has at most a row in ``counts`` for each character, so its sums
    are small however often it occurs.
    """
    sums = counts.groupBy("context").agg(
        *(F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)), *(F.count_if(F.col(f"n{c}") > 0).alias(f"kinds{c}") for c in (0, 1))
    )
    each = wanted.select("context", "next", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")).select("*", F.substring(F.col("context"), F.lit(ORDER + 1) - F.col("k"), F.col("k")).alias("part"))
    found = each.join(counts.withColumnRenamed("context", "part"), ["part", "next"], "left").join(sums.withColumnRenamed("context", "part"), "part", "left")
    numbers = [F.coalesce(f"{name}{c}", F.lit(0)).alias(f"{name}{c}") for name in ("n", "total", "kinds") for c in (0, 1)]
    own = found.groupBy("context", "next").agg(F.array_sort(F.collect_list(F.struct("k", *numbers))).alias("orders"))  # ORDER + 1 of them

    def log_p(c: int) -> Column:
        def backed_off(p: Column, o: Column) -> Column:
            weight = o[f"total{c}"] + o[f"kinds{c}"]
            return F.when(weight > 0, (o[f"n{c}"] + o[f"kinds{c}"] * p) / weight).otherwise(p)

        return F.log(F.aggregate("orders", F.lit(1.0 / ALPHABET), backed_off))

    return own.select("context", "next", F.round((log_p(1) - log_p(0)) * 2.0**UNIT).cast("bigint").alias("gain"))


def score_rows(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``__row`` and ``score`` of every row of ``rows`` (``__row``, ``__url``) whose URL isn't empty."""

    def made(_, keys, urls):
        for key, url in zip(keys, urls, strict=True):
            for (context, c), n in Counter(events(url)).items():
                yield key, context, c, n

    every = map_rows(rows, ["__row", "__url"], "__row bigint, context string, next string, n bigint", made)
    known = gains(every.select("context", "next").distinct(), counts)
    return every.join(known, ["context", "next"]).groupBy("__row").agg((F.sum(F.col("gain") * F.col("n")) / 2.0**UNIT / F.sum("n")).alias("score"))


def calibrate(tally: dict[int, list[int]]) -> float:
    """From numbers of rejected and accepted URLs by step of score: the middle of the best thresholds by balanced accuracy; 0 where a class has no URL."""
    rejected, accepted = (sum(v[c] for v in tally.values()) for c in (0, 1))
    if not rejected or not accepted:
        return 0.0
    steps = sorted(tally)
    below, best = [0, 0], []
    for at in [*steps, steps[-1] + 1]:  # a threshold at this step rejects all below it
        best.append((round(below[0] / rejected - below[1] / accepted, 12), at))
        for c in (0, 1):
            below[c] += tally.get(at, (0, 0))[c]
    most = max(b for b, _ in best)
    first = next(i for i, (b, _) in enumerate(best) if b == most)
    low = steps[first - 1] + 1 if first else steps[0]  # equally good from just above the step before
    return (low + best[first][1]) / 2 / 2**STEP


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule judged) of every row.

    URLs without a host, even null and empty ones (score 0), are judged by the
    models like others. With no labelled URLs of one class the threshold is 0;
    equal scores get equal verdicts, at the threshold ``allow``; of rules of one
    length the later one counts. Very long URLs are scored whole. Repeated rows
    are returned as often as they occur; other columns are not read; an empty
    table gives an empty result.
    """
    host, path = host_and_path(url_col)
    parts = df.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), verdict.alias("__verdict"), F.monotonically_increasing_id().alias("__row"))
    aside = F.col("rule").isNotNull() & (F.pmod(F.xxhash64(F.lit(SEED), "__url"), F.lit(CALIBRATE)) == 0)
    rows = cut(judged.select("*", F.coalesce(aside, F.lit(False)).alias("__aside"), (F.col("__verdict") == "allow").cast("int").alias("__class")))  # small: no other column
    counts = cut(count_contexts(rows.filter("rule is not null and not __aside")))
    scores = cut(score_rows(rows.filter("rule is null or __aside").select("__row", "__url"), counts))
    judged = rows.join(scores, "__row", "left").select("*", F.when(F.col("rule").isNull() | F.col("__aside"), F.coalesce("score", F.lit(0.0))).alias("__score"))
    step = F.floor(F.col("__score") * 2**STEP).alias("step")
    seen: dict[int, list[int]] = {}
    for at, kind, n in judged.filter("__aside").groupBy(step, "__class").count().collect():  # scores are small numbers: a few thousand steps
        seen.setdefault(at, [0, 0])[kind] = n
    threshold = calibrate(seen)
    own = F.when(F.col("rule").isNull(), F.col("__score"))
    kept = F.coalesce("__verdict", F.when(own >= threshold, "allow").otherwise("block"))
    return judged.select(F.col("__id").alias(id_col), "host", "path", "rule", kept.alias("verdict"), own.alias("score"))
