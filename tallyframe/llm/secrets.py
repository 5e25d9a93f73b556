"""Secret scan: fixed forms, and runs of characters that look random.

Three forms are found by pattern (``FORMS``).  On what is left, every long run of key characters is
scored by character Markov models: the log-likelihood ratio of the best of three models of random
strings (lower-case hexadecimal, upper case with digits, all key characters) against a model of
ordinary identifiers.  The models are counts of character pairs in labelled strings.

Everything is DataFrame expressions over a row's own text, without a shuffle; only the
counts of a fit (66 x 66 pairs per model) are aggregated and reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of the contract, in its order.
FORMS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST_LENGTH = {"assign": 6, "access": 20, "hex": 24}

KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", KEY_CHARACTERS]
RUN = "[A-Za-z0-9+/=_-]"
#: Characters a scored run must have, and the log-likelihood ratio (nats) it must reach.
LEAST_RUN = 16
LEAST_RATIO = 20.0
#: About so many rows of documents give the labelled strings of a fit.
FIT_ROWS = 5_000
#: Weight, in characters, of a random model's prior and of the single characters an ordinary pair falls back on.
PRIOR, SMOOTH = 1000.0, 33.0
_OUTSIDE = 1e-6
_CHUNK = 512


def _hits(text: Column, kind: str) -> Column:
    """Matches of a form, failing ones included.

    A run of one character class has no shorter match inside a failing one, so there the length is part of the
    pattern, which spares a list of all short runs.
    """
    return F.regexp_extract_all(text, F.lit(_searched(kind)), F.lit(0))


def _searched(kind: str) -> str:
    if kind == "access":
        return FORMS[kind][:-1] + f"{{{LEAST_LENGTH[kind] - len('AKIA')},}}"
    if kind == "hex":
        return FORMS[kind][:-1] + f"{{{LEAST_LENGTH[kind]},}}"
    return FORMS[kind]


def _long_enough(hit: Column, kind: str) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(hit, FORMS[kind], 2)) >= LEAST_LENGTH[kind]
    return F.length(hit) >= LEAST_LENGTH[kind]


def running_sums(steps: Column) -> Column:
    """Prefix sums of an array of longs, in chunks, so that a long array is not copied at each element."""

    def sums(values: Column) -> Column:
        last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("bigint"))
        return F.aggregate(values, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(last(a) + x)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")),
                         lambda k: F.slice(steps, k * _CHUNK + 1, F.lit(_CHUNK)))
    inner = F.transform(chunks, sums)
    totals = sums(F.transform(inner, lambda a: F.element_at(a, -1)))
    return F.when(F.size(steps) > 0, F.flatten(F.zip_with(
        inner, totals, lambda a, t: F.transform(a, lambda x: x + t - F.element_at(a, -1))))).otherwise(F.array().cast("array<bigint>"))


def _located(frame: DataFrame, name: str, order: int, pattern: str, hits: Column, keep) -> DataFrame:
    """Column ``name``: the kept hits as (start, order, end, hit), in code points; ``frame`` has the column ``text``."""
    frame = frame.withColumn("_hit", hits)
    # The pieces between the hits; a text without hits is not split.
    frame = frame.withColumn("_gap", F.when(F.size("_hit") > 0, F.split("text", pattern, -1)))
    steps = F.zip_with(F.slice("_gap", F.lit(1), F.size("_hit")), "_hit",
                       lambda gap, hit: (F.length(gap) + F.length(hit)).cast("bigint"))
    frame = frame.withColumn("_end", F.when(F.size("_hit") > 0, running_sums(steps)))
    spans = F.zip_with("_end", "_hit", lambda end, hit: F.struct(
        (end - F.length(hit)).alias("start"), F.lit(order).alias("order"), end.alias("end"), hit.alias("hit")))
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint,hit:string>>")
    return frame.withColumn(name, F.coalesce(F.filter(spans, lambda s: keep(s["hit"])), empty)).drop("_hit", "_gap", "_end")


def _masked(text: Column, kind: str) -> Column:
    """The text with as many blanks in place of each match of the form that is long enough."""
    blank = lambda hit: F.when(_long_enough(hit, kind), F.repeat(F.lit(" "), F.length(hit))).otherwise(hit)
    parts = F.zip_with(F.split(text, _searched(kind), -1), _hits(text, kind),
                       lambda gap, hit: F.concat(gap, F.coalesce(blank(hit), F.lit(""))))
    return F.when(F.size(_hits(text, kind)) > 0, F.array_join(parts, "")).otherwise(text)


def labelled_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of a fit: values of the fixed forms that hold a digit (1), all other runs of key characters (0).

    Taken from about ``fit_rows`` rows of ``docs``, chosen by a hash of id and text.
    """
    rows = max(1, docs.count())
    share = min(1 << 20, -(-fit_rows * (1 << 20) // rows))
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 20)) < share).select(text.alias("text"))

    def values(kind: str) -> Column:
        hits = F.filter(_hits(F.col("text"), kind), lambda hit: _long_enough(hit, kind))
        return F.transform(hits, lambda hit: F.regexp_extract(hit, FORMS[kind], 2)) if kind == "assign" else hits

    ones = some.select(F.explode(F.concat(*map(values, FORMS))).alias("text"), F.lit(1).alias("label")).filter(F.col("text").rlike("[0-9]"))
    rest = F.col("text")
    for kind in FORMS:
        rest = F.regexp_replace(rest, _searched(kind), " ")
    noughts = some.select(F.explode(F.regexp_extract_all(rest, F.lit(f"{RUN}{{2,}}"), F.lit(0))).alias("text"), F.lit(0).alias("label"))
    return ones.unionByName(noughts)


@dataclass(frozen=True)
class RandomnessModel:
    """Log-likelihood ratios in thousandths of a nat: ``ratios[a][66 * before + after]`` for each alphabet a."""

    ratios: tuple[tuple[int, ...], ...]


def train(samples: DataFrame) -> RandomnessModel:
    """Markov models from (text, label): 1 random string, 0 ordinary identifier; other labels and nulls are left out.

    A random string trains the smallest alphabet that holds it; its prior is the uniform
    distribution over the alphabet.  An ordinary pair is smoothed by the frequency of its second
    character, half of that uniform.  An ordinary string counts in upper case, too, so that names of constants
    are known.  Characters outside the key characters end a string.  Without samples the priors stand.
    """
    n = len(KEY_CHARACTERS)
    fits = F.lit(len(ALPHABETS) - 1)
    for k in range(len(ALPHABETS) - 2, -1, -1):
        fits = F.when(F.col("text").rlike(f"^[{ALPHABETS[k]}]*$"), F.lit(k)).otherwise(fits)
    model = F.when(F.col("label") == 1, fits).when(F.col("label") == 0, F.lit(len(ALPHABETS)))
    forms = F.when((F.col("label") == 0) & (F.upper("text") != F.col("text")), F.array("text", F.upper("text"))).otherwise(F.array("text"))
    strings = samples.select(model.alias("model"), F.explode(forms).alias("text")).filter("model IS NOT NULL")
    codes = strings.groupBy("model", "text").agg(F.count("*").alias("n")).select("model", "n", _codes(F.col("text")).alias("code"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("code") - 1), lambda i: F.struct(
        F.get("code", i - 1).alias("before"), F.get("code", i).alias("after")))
    counted = (codes.filter(F.size("code") > 1).select("model", "n", F.explode(pairs).alias("p"))
               .filter("p.before >= 0 AND p.after >= 0").groupBy("model", "p").agg(F.sum("n").alias("n")))
    counts = [[[0] * n for _ in range(n)] for _ in range(len(ALPHABETS) + 1)]
    for row in counted.collect():
        counts[row.model][row.p.before][row.p.after] = row.n
    ordinary, ratios = counts[-1], []
    single = [sum(row[c] for row in ordinary) for c in range(n)]
    back = [0.5 / n + 0.5 * single[c] / max(1, sum(single)) if any(single) else 1 / n for c in range(n)]
    for alphabet, held in zip(ALPHABETS, counts):
        prior = [1 / len(alphabet) if c in alphabet else 0.0 for c in KEY_CHARACTERS]
        table = []
        for before in range(n):
            total, plain = sum(held[before]) + PRIOR, sum(ordinary[before]) + SMOOTH
            for after in range(n):
                chance = max(_OUTSIDE, (held[before][after] + PRIOR * prior[after]) / total)
                table.append(round(1000 * (log(chance) - log((ordinary[before][after] + SMOOTH * back[after]) / plain))))
        ratios.append(tuple(table))
    return RandomnessModel(tuple(ratios))


def _codes(text: Column) -> Column:
    """Places of a string's characters in the key characters; -1 for others."""
    return F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(-1)).otherwise(F.position(c, F.lit(KEY_CHARACTERS)) - 1))


def ratio(text: Column, model: RandomnessModel) -> Column:
    """The log-likelihood ratio of a string, random against ordinary, in nats."""
    tables = [F.split(F.lit(",".join(map(str, t))), ",").cast("array<int>") for t in model.ratios]
    n = len(KEY_CHARACTERS)
    start = F.struct(F.lit(-1).alias("at"), F.array(*[F.lit(0).cast("bigint")] * len(tables)).alias("sums"))

    def step(held: Column, code: Column) -> Column:
        known = (held["at"] >= 0) & (code >= 0)
        sums = [F.get(held["sums"], F.lit(k)) + F.when(known, F.get(t, held["at"] * n + code)).otherwise(0) for k, t in enumerate(tables)]
        return F.struct(code.alias("at"), F.array(*sums).alias("sums"))

    return F.aggregate(_codes(text), start, step, lambda held: F.array_max(held["sums"])) / 1000


def scan_secrets(docs: DataFrame, model: RandomnessModel, id_col: str = "doc_id", text_col: str = "text",
                 least_ratio: float = LEAST_RATIO, least_run: int = LEAST_RUN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base and found.

    ``base`` lists the spans of the fixed forms, ``found`` those and the random-looking runs, as structs
    (kind, start, end, hit) by start and then kind; places are code points, the end is exclusive.  Matches of a
    form are leftmost and do not overlap; those that are too short are dropped but still take their characters.
    Random-looking runs are looked for outside the base spans: ``least_run`` key characters or more with a letter, and a
    log-likelihood ratio of ``least_ratio`` or more.  Null and empty texts have no spans; rows
    are judged alone, so repeated rows, null ids, an empty table and other columns change nothing.
    """
    frame = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for order, kind in enumerate(FORMS):
        frame = _located(frame, kind, order, _searched(kind), _hits(F.col("text"), kind), partial(_long_enough, kind=kind))
    frame = frame.withColumn("base", F.concat(*FORMS))
    rest = frame
    for kind in FORMS:
        rest = rest.withColumn("text", F.when(F.size("base") > 0, _masked(F.col("text"), kind)).otherwise(F.col("text")))
    runs = f"{RUN}{{{least_run},}}"
    rest = _located(rest, "random", len(FORMS), runs, F.regexp_extract_all("text", F.lit(runs), F.lit(0)),
                    lambda hit: hit.rlike("[A-Za-z]") & (ratio(hit, model) >= least_ratio))
    names = F.array(*[F.lit(k) for k in [*FORMS, "random"]])
    listed = lambda spans: F.transform(F.array_sort(spans), lambda s: F.struct(
        F.get(names, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))
    sizes = [F.size(k).cast("bigint").alias(f"n_{k}") for k in [*FORMS, "random"]]
    row = F.struct(*sizes, listed(F.col("base")).alias("base"), listed(F.concat("base", "random")).alias("found"))
    # A generator: a later filter on these columns reads them and does not search each text again.
    return rest.select("doc_id", F.inline(F.array(row)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
