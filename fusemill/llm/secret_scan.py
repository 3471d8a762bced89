"""Secret scan: fixed patterns plus sliding-window entropy, as column expressions only.

Every text is scanned whole. Spans are code-point offsets, end exclusive.

* ``assign``, ``access`` and ``hex`` are leftmost non-overlapping pattern hits.
* ``entropy`` spans come from candidate strings (runs of token characters at
  least one window long). A window slides over the candidate; the counts of its
  characters change by the one that enters and the one that leaves, and with
  them the sum of ``c * log2(c)``, kept in fixed point so that no rounding error
  builds up. The span runs from the first to the last window whose Shannon
  entropy reaches the threshold of the string's character class. Base spans and
  placeholder words that stand alone are cut out of a candidate first, and each
  piece of a window or more is judged for itself, as is each run between joining
  characters that draws on a small alphabet; overlapping spans are one.
  Allow-listed shapes (plain words, numbers, UUIDs) and spans that hold a
  placeholder are left out.

Defined results: null and empty texts have no spans (empty strings, zero
counts); repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm.common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A hit of AKIA[A-Z0-9]+ with 20 or more characters; shorter hits hold no longer one, so the bound may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: Likewise for maximal runs.
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: A run of one case and digits, or hex digits of both cases, between joining characters.
NARROW = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?:[a-z0-9]{20,}|[A-Z0-9]{20,}|[0-9A-Fa-f]{20,})(?![A-Za-z0-9])"
#: Bits that a window of a class must reach; the largest possible value for 20 characters is 4.32.
#: Of random windows over 36, 32 (base32) and 22 (hex in both cases) characters, 1 % lie below the values of lower, upper and hexes.
LEAST_BITS = {"digit": 3.1, "hex": 3.2, "hexes": 3.1, "upper": 3.3, "lower": 3.4, "mixed": 3.85}
#: The classes in the order in which they are tried; mixed is the rest. Strings of digits alone are on the allow-list.
CLASSES = {"digit": "^[0-9]+$", "hex": "^(?:[0-9a-f]+|[0-9A-F]+)$", "hexes": "^[0-9A-Fa-f]+$", "upper": "^[A-Z0-9]+$", "lower": "^[a-z0-9]+$"}
#: Shapes of strings that are no secrets. No pattern repeats a group: the JVM's matcher takes a stack frame for each turn.
ALLOWED = (
    r"^[A-Za-z]?[a-z]+$",
    r"^[A-Z]+$",
    r"^[0-9]+$",
    r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$",
)
#: A placeholder anywhere in a span, and as a word of its own between joining characters.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx"
PLACEHOLDER_WORD = r"(?i)(?<![a-z0-9])(?:example|sample|dummy|changeme|placeholder|your|xxxx+)(?![a-z0-9])"
JOINERS = "[+/_=-]"
#: Words of letters joined by single signs are allowed as well: such a string has none of these.
NOT_WORDS = r"[^A-Za-z/_-]|^[/_-]|[/_-]$|[/_-]{2}"
RUN = 256
_ONE = 1 << 20
_FOUND = "array<struct<s:int,e:int,t:string>>"


def _hits(text: Column, pattern: str) -> Column:
    """Start, end and text of each leftmost non-overlapping hit: the texts between hits add up to the offsets."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(hits)), F.length).alias("g"), hits.alias("t"))

    # Places are summed up in runs of RUN hits, then over the runs: growing one array hit by hit takes time with its square.
    def in_run(z: Column, k: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["g"]
            end = start + F.length(x["t"])
            return F.struct(end.alias("at"), F.concat(a["o"], F.array(F.struct(start.alias("s"), end.alias("e"), x["t"].alias("t")))).cast(_FOUND).alias("o"))

        return F.aggregate(F.slice(z, k * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("o")), step)

    def joined(runs: Column) -> Column:
        starts = F.aggregate(
            runs,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("o")),
            lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["o"], F.array(a["at"])).alias("o")),
            lambda a: a["o"],
        )
        return _let(starts, lambda at: F.flatten(F.transform(runs, lambda r, k: _shifted(r["o"], at[k]))))

    runs = _let(sizes, lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / RUN).cast("int")), lambda k: in_run(z, k)))
    found = _let(runs, joined).cast(_FOUND)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_FOUND))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _hot_span(c: Column, window: int, least_bits: dict[str, float]) -> Column:
    """First and last position (in the candidate c) of windows whose entropy reaches its class's threshold; s is -1 if none does."""
    f = F.array(*(F.lit(round(n * math.log2(n) * _ONE) if n else 0).cast("long") for n in range(window + 1)))
    limit = {k: F.lit(math.floor(window * (math.log2(window) - bits) * _ONE)).cast("long") for k, bits in least_bits.items()}
    most = F.coalesce(*(F.when(c["t"].rlike(shape), limit[k]) for k, shape in CLASSES.items()), limit["mixed"])

    def slide(x: Column) -> Column:
        def step(a: Column, ch: Column) -> Column:
            w, full = a["w"], F.length(a["w"]) >= window
            gone = F.when(full, F.left(w, F.lit(1))).otherwise("")
            count = lambda c: F.length(w) - F.length(F.replace(w, c, F.lit("")))

            def change(d: Column) -> Column:
                # the two counts that change: of the character that enters and of the one that leaves
                delta = x["f"][d["in"] + 1] - x["f"][d["in"]] + F.when(d["full"], x["f"][F.greatest(F.lit(0), d["out"] - 1)] - x["f"][d["out"]]).otherwise(F.lit(0).cast("long"))
                kept = F.when(d["full"], F.substring(w, 2, window - 1)).otherwise(w)
                return F.struct((a["i"] + 1).alias("i"), F.concat(kept, ch).alias("w"), F.when(d["gone"] == ch, a["q"]).otherwise(a["q"] + delta).alias("q"))

            moved = _let(F.struct(count(ch).alias("in"), F.when(full, count(gone)).otherwise(0).alias("out"), full.alias("full"), gone.alias("gone")), change)

            def judge(b: Column) -> Column:
                hot = (b["i"] >= window) & (b["q"] <= x["most"])
                return F.struct(
                    b["i"].alias("i"), b["w"].alias("w"), b["q"].alias("q"),
                    F.when(hot & (a["s"] < 0), b["i"] - window).otherwise(a["s"]).alias("s"),
                    F.when(hot, b["i"]).otherwise(a["e"]).alias("e"),
                )

            return _let(moved, judge)

        start = F.struct(F.lit(0).alias("i"), F.lit("").alias("w"), F.lit(0).cast("long").alias("q"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
        return F.aggregate(x["chars"], start, step, lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e")))

    return _let(F.struct(F.split(c["t"], "").alias("chars"), f.alias("f"), most.alias("most")), slide)


def _chunks(spans: Column) -> Column:
    """Runs of RUN spans (z) with the first start and the last end of each: what overlaps a place is looked for in few of them."""

    def one(z: Column) -> Column:
        return F.struct(F.array_min(F.transform(z, lambda x: x["s"])).alias("s"), F.array_max(F.transform(z, lambda x: x["e"])).alias("e"), z.alias("z"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int")), lambda k: _let(F.slice(spans, k * RUN + 1, F.lit(RUN)), one))


def _pieces(c: Column, chunks: Column, window: int) -> Column:
    """What is left of c without the cuts (in chunks) and one joining character beside each, as far as it is a window long."""
    over = lambda z: (z["s"] < c["e"]) & (c["s"] < z["e"])
    near = F.flatten(F.transform(F.filter(chunks, over), lambda k: k["z"]))
    inner = F.array_sort(F.transform(F.filter(near, over), lambda z: F.struct(z["s"].alias("s"), z["e"].alias("e"))))

    def joins(at: Column) -> Column:
        return F.when(c["t"].substr(at - c["s"] + 1, F.lit(1)).rlike(JOINERS), 1).otherwise(0)

    def add(o: Column, s: Column, e: Column) -> Column:
        piece = F.struct(s.alias("s"), e.alias("e"), c["t"].substr(s - c["s"] + 1, e - s).alias("t"))
        return F.when(e - s >= window, F.concat(o, F.array(piece))).otherwise(o).cast(_FOUND)

    def cut(a: Column, z: Column) -> Column:
        end = F.when(z["s"] > c["s"], z["s"] - joins(z["s"] - 1)).otherwise(z["s"])
        return F.struct(F.greatest(a["at"], F.when(z["e"] < c["e"], z["e"] + joins(z["e"])).otherwise(z["e"])).alias("at"), add(a["o"], a["at"], end).alias("o"))

    start = F.struct(c["s"].alias("at"), F.array().cast(_FOUND).alias("o"))
    return F.when(F.size(inner) == 0, F.array(c).cast(_FOUND)).otherwise(F.aggregate(inner, start, cut, lambda a: add(a["o"], a["at"], c["e"])))


def _shifted(hits: Column, by: Column) -> Column:
    return F.transform(hits, lambda z: F.struct((z["s"] + by).alias("s"), (z["e"] + by).alias("e"), z["t"].alias("t")))


def _merged(spans: Column) -> Column:
    """Spans (structs of s and e) with overlapping ones made one; finished ones are kept in runs of RUN, since an array that grows one by one takes time with its square."""
    kind, runs = "array<struct<s:int,e:int>>", "array<array<struct<s:int,e:int>>>"

    def add(a: Column, z: Column) -> Column:
        last = a["last"]
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], z["e"]).alias("e"))
        part = F.concat(a["part"], F.array(last)).cast(kind)
        full = F.size(a["part"]) + 1 >= RUN
        moved = F.struct(F.when(full, F.concat(a["full"], F.array(part))).otherwise(a["full"]).cast(runs).alias("full"), F.when(full, F.array().cast(kind)).otherwise(part).alias("part"), z.alias("last"))
        return F.when(z["s"] < last["e"], F.struct(a["full"].alias("full"), a["part"].alias("part"), longer.alias("last"))).otherwise(moved)

    def fold(z: Column) -> Column:
        start = F.struct(F.array().cast(runs).alias("full"), F.array().cast(kind).alias("part"), z[0].alias("last"))
        return F.aggregate(z, start, add, lambda a: F.flatten(F.concat(a["full"], F.array(F.concat(a["part"], F.array(a["last"])).cast(kind)))))

    return F.when(F.size(spans) < 2, spans.cast(kind)).otherwise(_let(F.array_sort(spans.cast(kind)), fold))


def scan(
    df: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    least_bits: dict[str, float] = LEAST_BITS,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """df with n_assign, n_access, n_hex, n_entropy (long), base_sha256 and spans (string)."""
    x = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    secret = F.regexp_extract_all(x, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform(
        F.filter(F.arrays_zip(_hits(x, ASSIGN).alias("h"), F.when(x.rlike(ASSIGN), secret).otherwise(F.array().cast("array<string>")).alias("v")), lambda z: F.length(z["v"]) >= 6),
        lambda z: z["h"],
    )
    out = df.withColumns({"__assign": long_enough, "__access": _hits(x, ACCESS), "__hex": _hits(x, HEX), "__maybe": _hits(x, CANDIDATE)})
    base = F.concat("__assign", "__access", "__hex")
    runs = F.flatten(F.transform("__maybe", lambda c: _shifted(_hits(c["t"], NARROW), c["s"])))
    words = F.flatten(F.transform("__maybe", lambda c: _shifted(_hits(c["t"], PLACEHOLDER_WORD), c["s"])))
    out = out.withColumn("__cuts", F.concat(base, words)).withColumn("__maybe", F.array_distinct(F.concat("__maybe", runs)))
    out = out.withColumn("__cuts", F.when(F.size("__cuts") > 0, _chunks(F.col("__cuts"))).otherwise(F.array()))
    # bound together, or the optimizer puts the cuts' expression into the function, which then runs once a candidate
    both = F.struct(F.col("__cuts").alias("cuts"), F.col("__maybe").alias("maybe"))
    out = out.withColumn("__maybe", _let(both, lambda x: F.flatten(F.transform(x["maybe"], lambda c: _pieces(c, x["cuts"], window)))))

    def open_(c: Column) -> Column:
        listed = ~c["t"].rlike(NOT_WORDS)
        for pattern in allowed:
            listed = listed | c["t"].rlike(pattern)
        return ~listed

    judged = F.transform(
        F.filter("__maybe", open_),
        lambda c: _let(
            _hot_span(c, window, least_bits),
            lambda a: F.struct((c["s"] + a["s"]).alias("s"), (c["s"] + a["e"]).alias("e"), ((a["s"] >= 0) & ~c["t"].substr(a["s"] + 1, a["e"] - a["s"]).rlike(PLACEHOLDER)).alias("hot")),
        ),
    )
    hot = F.transform(F.filter(judged, lambda z: z["hot"]), lambda z: F.struct(z["s"].alias("s"), z["e"].alias("e")))
    out = out.withColumn("__entropy", _merged(hot))

    def tag(k: int, kind: str) -> Column:
        return F.transform(f"__{kind}", lambda z: F.struct(z["s"].alias("s"), F.lit(k).alias("k"), F.concat_ws(":", F.lit(kind), z["s"], z["e"]).alias("v")))

    tagged = [tag(k, kind) for k, kind in enumerate(KINDS)]

    def joined(*spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat(*spans)), lambda z: z["v"]), ",")

    out = out.withColumns(
        {f"n_{kind}": F.size(f"__{kind}").cast("long") for kind in KINDS}
        | {"base_sha256": F.sha2(joined(*tagged[:3]), 256), "spans": joined(*tagged)}
    )
    return out.drop("__maybe", "__cuts", *(f"__{kind}" for kind in KINDS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
