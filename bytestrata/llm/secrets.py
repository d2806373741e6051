"""Secret scans: base rules plus character Markov models, with DataFrame functions only.

Base rules are three regular expressions. Beyond them, every long run of key characters, or each long piece
of it that base spans leave open, is scored by two first-order character Markov models, one of random strings
and one of ordinary identifiers; it is a secret if its log-likelihood ratio per transition reaches a threshold. Both models are counted from
labelled samples, whose labels the base rules make: random strings are digests of numbers in several alphabets and what the
access and hex rules find, identifiers are the other words of a bounded sample of rows (SAMPLE_DOCS of them, those
with the lowest hash of doc_id), as they are and in upper case.

Positions come from splitting a text at the matches of the same expression: the lengths of the pieces and
of the matches add up to where each match starts, in code points. All steps are linear in the length of a text and in the
number of its spans, but for a small part that works on blocks: a long run or many spans hold up no task.

Defined results: a null text is the empty text and has no spans; repeated rows are scanned each for
itself; an empty table gives an empty result and the models then stand on the generated samples alone;
other columns are carried along by redact() and ignored by scan().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bytestrata.llm.common import carried, pick

#: Kinds in the order in which spans of one start are listed; fixed values of the contract.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Runs that the models score, and the least mean log-likelihood ratio of a secret.
RUN_LEAST = 20
RUN = rf"[A-Za-z0-9+/_-]{{{RUN_LEAST},}}"
SAMPLE_RUN = r"[A-Za-z0-9+/_-]{8,}"
THRESHOLD = 0.5
SAMPLE_DOCS = 4096
_LOW, _N = 43, 80  # "+" is the lowest code of a run, "z" the highest


#: Elements and code points that are worked on at once where a step would else take the whole of a long array or text.
_BLOCK, _CHUNK = 256, 4096


def let(value: Column, body) -> Column:
    """body(value), with the value computed once, also where the body uses it in a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step, start: int) -> Column:
    """The steps (sums or greatest) over an array up to each element, in blocks, so that a long array costs little more than its length."""
    grow = lambda a: F.aggregate(a, F.array().cast("array<bigint>"), lambda z, x: F.concat(z, F.array(step(F.coalesce(F.try_element_at(z, F.lit(-1)), F.lit(start).cast("bigint")), x))))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: grow(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
    heads = lambda l: grow(F.transform(l, lambda q: F.element_at(q, -1)))
    whole = lambda l: let(heads(l), lambda h: F.flatten(F.transform(l, lambda q, i: F.when(i == 0, q).otherwise(F.transform(q, lambda x: step(F.get(h, i - 1), x))))))
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(let(blocks(v), whole)))


def pieces(text: Column, spans: Column) -> Column:
    """The substrings of a text at an array of spans, from chunks of it, so that a place far into a long text costs no more than others."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _CHUNK).cast("int")), lambda b: F.substr(text, b * _CHUNK + 1, F.lit(_CHUNK)))
    first = lambda s: F.floor(s["start"] / _CHUNK).cast("int")
    last = lambda s: F.greatest(first(s), F.floor((s["end"] - 1) / _CHUNK).cast("int"))
    low = lambda s, k: F.greatest(s["start"] - k * _CHUNK, F.lit(0)).cast("int")
    high = lambda s, k: F.least(s["end"] - k * _CHUNK, F.lit(_CHUNK)).cast("int")
    part = lambda s, c, k: F.substr(c, low(s, k) + 1, high(s, k) - low(s, k))
    one = lambda l, s: F.array_join(F.transform(F.slice(l, first(s) + 1, last(s) - first(s) + 1), lambda c, j: part(s, c, first(s) + j)), "")
    return let(chunks, lambda l: F.transform(spans, lambda s: one(l, s)))


_NO_SPANS = "cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"


def _spans(df: DataFrame, name: str, pattern: str, kind: int, value_least: int = 0) -> DataFrame:
    """Adds column name: array of (start, kind, end) of the matches of a pattern in column text."""
    p, long = F.lit(pattern), lambda c: F.length(c).cast("bigint")
    df = df.withColumn("_m", F.regexp_extract_all("text", p, F.lit(0)))
    some = F.size("_m") > 0
    # everything that a loop reads is bound first: an expression inside of a loop would be computed for every match
    values = F.regexp_extract_all("text", p, F.lit(2)) if value_least else F.lit(None).cast("array<string>")
    read = F.struct(F.col("_m").alias("m"), F.transform(F.split("text", pattern, -1), long).alias("n"), values.alias("v"))
    lengths = lambda z: F.flatten(F.transform(z["m"], lambda x, i: F.array(F.get(z["n"], i), long(x))))
    span = lambda b, i: F.struct(F.get(b, 2 * i).alias("start"), F.lit(kind).alias("kind"), F.get(b, 2 * i + 1).alias("end"))
    every = lambda z: let(running(lengths(z), lambda a, b: a + b, 0), lambda b: F.transform(z["m"], lambda x, i: span(b, i)))
    if value_least:
        found = let(read, lambda z: F.filter(every(z), lambda x, i: F.length(F.get(z["v"], i)) >= value_least))
    else:
        found = let(read, every)
    return df.withColumn(name, F.when(some, found).otherwise(F.expr(_NO_SPANS))).drop("_m")


def base_spans(df: DataFrame) -> DataFrame:
    """Adds assign, access and hex: arrays of the spans that the base rules find."""
    df = _spans(df, "assign", ASSIGN, 0, ASSIGN_LEAST)
    return _spans(_spans(df, "access", ACCESS, 1), "hex", HEX, 2)


def _random_strings(spark: SparkSession) -> DataFrame:
    """Digests of numbers as strings of several alphabets."""
    n = spark.range(1024).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    base64 = F.regexp_replace(F.base64(F.unhex("d")), "=", "")
    upper = F.translate(F.upper(base64), "+/", "7Q")
    letters = F.translate(base64, "+/0123456789", "xQaKrTbZmWpD")
    return n.select(F.explode(F.array("d", F.substring("d", 1, 40), base64, upper, F.translate(base64, "+/", "-_"), letters)).alias("run"))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(run, random): strings known to be random (1) and ordinary identifiers (0)."""
    own = pick(docs, "doc_id", "text")
    ids = own.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    some = own.join(F.broadcast(ids), "doc_id", "left_semi").filter(F.col("text").isNotNull())
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs)  # a doc_id can have any number of rows
    known = base_spans(some.select("text"))
    values = known.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("run"))
    # what stands in one run with a key is not known to be ordinary
    around = lambda p: rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]*{p}[A-Za-z0-9+/_-]*"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), around(ACCESS), " "), around(HEX), " ")
    words = known.select(F.explode(F.regexp_extract_all(plain, F.lit(SAMPLE_RUN), F.lit(0))).alias("run"))
    ordinary = words.select(F.explode(F.array("run", F.upper("run"))).alias("run"))
    random = _random_strings(docs.sparkSession).unionByName(values)
    return random.withColumn("random", F.lit(1)).unionByName(ordinary.withColumn("random", F.lit(0)))


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, from labelled samples; at most 2 * 80 * 80 counts reach the driver."""
    step = transitions(F.col("run"), lambda at: at)
    counted = samples.filter(F.length("run") > 1).select("random", F.explode(step).alias("step")).groupBy("random", "step").count().collect()
    seen = [[0.0] * (_N * _N), [0.0] * (_N * _N)]
    for random, at, count in counted:
        if 0 <= at < _N * _N:
            seen[random][at] = float(count)
    def logs(counts: list[float]) -> list[float]:
        rows = [sum(counts[r * _N : r * _N + _N]) for r in range(_N)]
        return [math.log((c + 0.5) / (rows[i // _N] + 0.5 * _N)) for i, c in enumerate(counts)]
    ordinary, random = logs(seen[0]), logs(seen[1])
    return [b - a for a, b in zip(ordinary, random)]


def transitions(run: Column, value) -> Column:
    """An array of value(number of the transition) for each transition of a run of two characters or more."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - _LOW)
    every = lambda c, n: F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: value(a * _N + b))
    return let(codes, lambda c: every(c, F.length(run) - 1))


def ratio(run: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio, random against ordinary, of a run's transitions."""
    # the literal is folded into one constant array
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    total = F.aggregate(transitions(run, lambda at: F.element_at(values, at + 1)), F.lit(0.0), lambda a, x: a + x)
    return total / (F.length(run) - 1)


def _open_pieces(df: DataFrame) -> DataFrame:
    """Cuts the spans of _runs to the pieces that base spans leave open, of RUN_LEAST characters and more.

    Base spans by start, which can overlap, leave gaps: each begins where the furthest span so far has ended. Runs and
    gaps are each disjoint, so a piece begins with one of them and ends with the first of the run and the gap that began last.
    """
    df = df.withColumn("_base", F.array_sort(F.concat("assign", "access", "hex")))
    far = lambda values: running(values, lambda a, b: F.greatest(a, b), 0)
    end = F.length("text").cast("bigint")
    gap = lambda a, b: F.struct(a.alias("start"), F.lit(0).alias("kind"), b.alias("end"))
    gaps = lambda most: F.filter(F.transform(F.concat("_base", F.array(F.struct(end.alias("start"), F.lit(0).alias("kind"), end.alias("end")))), lambda s, i: gap(F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(most, i - 1)), s["start"])), lambda g: g["start"] < g["end"])
    df = df.withColumn("_gaps", let(far(F.transform("_base", lambda s: s["end"])), gaps))
    df = df.withColumn("_events", F.array_sort(F.concat("_gaps", "_runs")))
    ends = lambda kind: far(F.transform("_events", lambda e: F.when(e["kind"] == kind, e["end"]).otherwise(F.lit(0).cast("bigint"))))
    # of a gap and a run that begin together the run, which sorts last, makes the piece
    piece = lambda e, g, r: F.struct(e["start"].alias("start"), F.lit(3).alias("kind"), F.least(g, r).alias("end"))
    found = lambda g: let(ends(3), lambda r: F.transform("_events", lambda e, i: piece(e, F.get(g, i), F.get(r, i))))
    cut = F.filter(let(ends(0), found), lambda p: p["end"] - p["start"] >= RUN_LEAST)
    both = (F.size("_base") > 0) & (F.size("_runs") > 0)
    return df.withColumn("_runs", F.when(both, cut).otherwise(F.col("_runs"))).drop("_base", "_gaps", "_events")


def spans(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Adds assign, access, hex and markov (arrays of spans) to a table with column text, which gets "" for null."""
    df = base_spans(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    df = _open_pieces(_spans(df, "_runs", RUN, 3))
    df = df.withColumn("_texts", F.when(F.size("_runs") > 0, pieces(F.col("text"), F.col("_runs"))))
    random = F.filter(F.arrays_zip("_runs", "_texts"), lambda x: ratio(x["_texts"], table) >= threshold)
    return df.withColumn("markov", F.when(F.size("_runs") > 0, F.transform(random, lambda x: x["_runs"])).otherwise(F.expr(_NO_SPANS))).drop("_runs", "_texts")


def listed(*columns: str) -> Column:
    """kind:start:end of the spans by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*columns)), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans, of every whole text."""
    found = spans(pick(docs, "doc_id", "text"), fit(labelled_samples(docs)))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed("assign", "access", "hex").cast("binary"), 256).alias("base_sha256"), listed("assign", "access", "hex", "markov").alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by a mark; n_chars follows the text. Texts without secrets, null too, stay as they are."""
    own, back = carried(docs, "doc_id", "text", "n_chars")
    table = fit(labelled_samples(own))
    found = spans(own.withColumn("_was", F.col("text")), table)
    found = found.withColumn("_all", F.array_sort(F.concat("assign", "access", "hex", "markov"))).drop("assign", "access", "hex", "markov")
    # spans of different kinds can overlap: what is kept starts where the furthest span before it has ended
    end = F.length("text").cast("bigint")
    gap = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    starts = lambda most: F.transform("_all", lambda s, i: gap(F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(most, i - 1)), s["start"]))
    kept = lambda most: F.concat(F.filter(starts(most), lambda g: g["start"] <= g["end"]), F.array(gap(F.element_at(most, -1), end)))
    far = running(F.transform("_all", lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
    found = found.withColumn("_kept", F.when(F.size("_all") > 0, let(far, kept)))
    text = F.when(F.size("_all") > 0, F.array_join(pieces(F.col("text"), F.col("_kept")), mark)).otherwise(F.col("_was"))
    out = found.withColumn("text", text).drop("_all", "_was", "_kept")
    return back(out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))))


ORACLE = None
