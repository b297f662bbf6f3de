"""Secrets in texts: known forms, and tokens that a battery of randomness tests takes for random.

Three known forms are searched by pattern: assignments to names such as password, access keys, and runs
of hexadecimal digits. Beside them every run of 20 or more characters that ciphers and encoders use is a
candidate. Its alphabet is inferred (hexadecimal, base 32, base 36, base 62, base 64 in both spellings) and
it is tested as a string of symbols 0 to A-1:

* chi-squared: sum of squared counts against that of a uniform alphabet, by its exact mean and variance;
* runs: changes between the lower and the upper half of the alphabet, binomial under randomness;
* serial correlation: each symbol with the next, the last with the first.

The three p-values are combined by Fisher's method; a token stays a candidate at LEAST_RANDOM or more. To
be reported it must also be unlike ordinary writing: the chance that ordinary letters of that number have
so few equal pairs, times that of meeting only the digits of a small alphabet. These chances are held to a
false-discovery rate of LEVEL within the document (Benjamini and Hochberg), weighted by length, so that
long tokens, of which the tests can tell more, spend more of the rate than short ones.

Everything is built-in functions on the row of a document: no shuffle and no Python worker. Places are
summed in log2(n) rounds over the pieces between matches.

Defined results: null text counts as empty; an empty text has no span and the digest of the empty string;
rows that repeat a key are scanned each; places count code points, ends are exclusive; spans of one start
come in the order of KINDS, and spans of different kinds may overlap; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of equal starts.
KINDS = ("assign", "access", "hex", "random")
#: Least length of the value of an assignment, and of a candidate token.
LEAST_VALUE, LEAST_TOKEN = 12, 20
#: Least combined p-value of a token that counts as random, and false-discovery rate in a document.
LEAST_RANDOM, LEVEL = 0.001, 0.01


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern finds what filtering all runs would.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
TOKEN = f"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}={{0,2}}"
# A run is looked at from its first character only.
_TOKEN_JAVA = "(?<![A-Za-z0-9+/_-])" + TOKEN

_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order they are tried: name, form of the whole token, alphabet in order.
ENCODINGS = (
    ("digits", "[0-9]+", ""),
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("hex", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("base32", "[A-Z2-7]+", _SMALL.upper() + "234567"),
    ("base36", "[0-9a-z]+", _DIGITS + _SMALL),
    ("base36", "[0-9A-Z]+", _DIGITS + _SMALL.upper()),
    ("base62", "[0-9A-Za-z]+", _DIGITS + _SMALL.upper() + _SMALL),
    ("base64", "[A-Za-z0-9+/]+", _SMALL.upper() + _SMALL + _DIGITS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+", _SMALL.upper() + _SMALL + _DIGITS + "-_"),
)
#: Of ordinary writing: sums of squared and cubed letter shares, and the share of a digit or a to f.
SQUARES, CUBES, IN_HEX = 0.065, 0.0054, 0.5


def _summed(array: str) -> str:
    """Running sums of an array of numbers, in log2(size) rounds of adding what stands 2**round before."""
    rounds = f"sequence(1, cast(ceil(log2(size({array}))) as int))"
    step = "transform(acc, (x, i) -> x + if(i >= shiftleft(1, k - 1), get(acc, i - shiftleft(1, k - 1)), 0))"
    return f"if(size({array}) < 2, {array}, aggregate({rounds}, {array}, (acc, k) -> {step}))"


def _found(df: DataFrame, name: str, pattern: str, possible: Column, value: int = 0) -> DataFrame:
    """Adds the leftmost matches of a pattern: array of (start, end, value), the value being a group's text."""
    nothing = F.array().cast("array<string>")
    regex = F.lit(pattern)
    df = df.withColumn("matches_", F.when(possible, F.regexp_extract_all("text_", regex, F.lit(0))).otherwise(nothing))
    some = F.size("matches_") > 0
    df = df.withColumn("values_", F.col("matches_") if not value else F.when(some, F.regexp_extract_all("text_", regex, F.lit(value))).otherwise(nothing))
    df = df.withColumn("between_", F.when(some, F.split("text_", pattern, -1)).otherwise(nothing))
    # Arrays beside each other are zipped: one named inside a lambda could be worked out per element.
    steps = F.zip_with("matches_", "between_", lambda m, b: F.length(m) + F.length(b))
    df = df.withColumn("steps_", F.slice(steps, F.lit(1), F.size("matches_")))
    df = df.withColumn("ends_", F.expr(_summed("steps_")))
    spans = F.transform(
        F.arrays_zip("matches_", "ends_", "values_"),
        lambda s: F.struct((s["ends_"] - F.length(s["matches_"])).alias("start"), s["ends_"].alias("end"), s["values_"].alias("value")),
    )
    return df.withColumn(name, spans).drop("matches_", "values_", "between_", "steps_", "ends_")


def _tail(z: str) -> str:
    """Two-sided chance of a normal deviate, by the logistic form of its distribution."""
    return f"(2 / (1 + exp(least(abs({z}), 12D) * (1.5976D + 0.070565992D * least(abs({z}), 12D) * least(abs({z}), 12D)))))"


def _below(z: str) -> str:
    cut = f"greatest(least({z}, 12D), -12D)"
    return f"(1 / (1 + exp(-{cut} * (1.5976D + 0.070565992D * {cut} * {cut}))))"


def _battery(df: DataFrame) -> DataFrame:
    """Replaces ``tokens`` by their test results: (start, end, encoding, n, random, ordinary)."""
    core = F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.rtrim(t["value"], F.lit("=")).alias("core")))
    df = df.withColumn("tokens", core)

    def chosen(place: int) -> str:
        cases = " ".join(f"when t.core rlike '^{form}$' then '{(name, alphabet)[place]}'" for name, form, alphabet in ENCODINGS)
        return f"case {cases} else '' end"

    df = df.withColumn("tokens", F.expr(f"transform(tokens, t -> struct(t.start, t.end, t.core, {chosen(0)} as encoding, {chosen(1)} as alphabet))"))
    df = df.withColumn("tokens", F.expr("filter(tokens, t -> t.alphabet != '')"))
    symbols = "transform(regexp_extract_all(t.core, '.', 0), c -> cast(instr(t.alphabet, c) - 1 as bigint))"
    halves = "translate(t.core, t.alphabet, concat(repeat('0', length(t.alphabet) div 2), repeat('1', length(t.alphabet) div 2)))"
    squares = "aggregate(sequence(1, length(t.alphabet)), 0L, (acc, i) -> acc + cast(pow(length(t.core) - length(replace(t.core, substr(t.alphabet, i, 1), '')), 2) as bigint))"
    df = df.withColumn(
        "tokens",
        F.expr(f"transform(tokens, t -> struct(t.start, t.end, t.encoding, length(t.core) as n, length(t.alphabet) as a, {squares} as q, {symbols} as x, {halves} as b))"),
    )
    changes = "(2 * t.n - length(replace(t.b, '01', '')) - length(replace(t.b, '10', ''))) div 2"
    sums = "aggregate(t.x, 0L, (acc, v) -> acc + v) as s1, aggregate(t.x, 0L, (acc, v) -> acc + v * v) as s2"
    pairs = "aggregate(sequence(0, t.n - 1), 0L, (acc, i) -> acc + get(t.x, i) * get(t.x, (i + 1) % t.n)) as s3"
    df = df.withColumn("tokens", F.expr(f"transform(tokens, t -> struct(t.start, t.end, t.encoding, t.n, t.a, t.q, {changes} as c, {sums}, {pairs}))"))
    z1 = "((cast(t.a * t.q as double) / t.n - t.n - (t.a - 1)) / sqrt(2D * (t.a - 1) * (t.n - 1) / t.n))"
    z2 = "((t.c - (t.n - 1) / 2D) / (sqrt(cast(t.n - 1 as double)) / 2D))"
    flat = "t.n * t.s2 = t.s1 * t.s1"
    z3 = f"(case when {flat} then 12D else (cast(t.n * t.s3 - t.s1 * t.s1 as double) / (t.n * t.s2 - t.s1 * t.s1) + 1D / (t.n - 1)) * (t.n - 1) * sqrt(cast(t.n - 2 as double)) / t.n end)"
    pairs_sd = f"sqrt(2D * t.n * (t.n - 1) * ({SQUARES}D - {SQUARES**2}D) + 4D * t.n * (t.n - 1) * (t.n - 2) * ({CUBES}D - {SQUARES**2}D))"
    z4 = f"((t.q - t.n - {SQUARES}D * t.n * (t.n - 1)) / {pairs_sd})"
    evidence = " + ".join(f"-ln({_tail(z)})" for z in (z1, z2, z3))
    ordinary = f"{_below(z4)} * case when t.encoding = 'hex' then pow({IN_HEX}D, t.n) else 1D end"
    df = df.withColumn("tokens", F.expr(f"transform(tokens, t -> struct(t.start, t.end, t.encoding, t.n, {evidence} as u, {ordinary} as ordinary))"))
    return df.withColumn("tokens", F.expr("transform(tokens, t -> struct(t.start, t.end, t.encoding, t.n, exp(-t.u) * (1 + t.u + t.u * t.u / 2) as random, t.ordinary))"))


def _discoveries(df: DataFrame, least_random: float, level: float) -> DataFrame:
    """Keeps the ``tokens`` that are random enough and discovered at the false-discovery rate."""
    size = "array_repeat({}, size(tokens))"
    mean = size.format("cast(aggregate(tokens, 0L, (acc, t) -> acc + t.n) as double) / greatest(size(tokens), 1)")
    weighed = "struct(t.start, t.end, t.encoding, t.n, t.random, t.ordinary, t.ordinary * mean / t.n as weighed)"
    df = df.withColumn("tokens", F.expr(f"zip_with(tokens, {mean}, (t, mean) -> {weighed})"))
    df = df.withColumn("sorted_", F.expr("sort_array(transform(tokens, t -> t.weighed))"))
    cut = size.format(f"array_max(transform(sorted_, (q, i) -> if(q <= {level}D * (i + 1) / size(sorted_), q, -1D)))")
    held = f"zip_with(tokens, {cut}, (t, cut) -> if(t.weighed <= cut and t.random >= {least_random}D, t, null))"
    return df.withColumn("tokens", F.expr(f"filter({held}, t -> t is not null)")).drop("sorted_")


def _named(kind: str, column: str | None = None) -> Column:
    """The spans of a column as (start, order, end, kind)."""
    return F.expr(f"transform({column or kind}, s -> struct(s.start, {KINDS.index(kind)} as order, s.end, '{kind}' as kind))")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least_random: float = LEAST_RANDOM, level: float = LEVEL) -> DataFrame:
    """Per row of ``docs``: key, ``base`` (array of start, order, end, kind) and ``tokens`` (array of start,
    end, encoding, n, random, ordinary, weighed): known forms, and tokens found random."""
    df = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text_"))
    small = F.lower("text_")
    named = small.contains("passw") | small.contains("secret") | small.contains("token") | (small.contains("api") & small.contains("key"))
    df = _found(df, "assign", ASSIGN, named, value=2)
    df = _found(df, "access", ACCESS, F.col("text_").contains("AKIA"))
    df = _found(df, "hex", HEX, F.lit(True))
    df = _found(df, "tokens", _TOKEN_JAVA, F.lit(True))
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= LEAST_VALUE))
    df = df.select("key_", F.sort_array(F.concat(*[_named(kind) for kind in KINDS[:3]])).alias("base"), "tokens")
    return _discoveries(_battery(df), least_random, level).select(F.col("key_").alias(key), "base", "tokens")


def written(spans: Column) -> Column:
    """Sorted spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the spans of ``scan``."""
    found = found.withColumn("base_", written(F.col("base")))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint) as n_{kind}") for kind in KINDS[:3]]
    return found.select(key, *counts, F.sha2("base_", 256).alias("base_sha256"), written(F.sort_array(F.concat("base", _named("random", "tokens")))).alias("spans"))


def _sql_spans(kind: str, pattern: str, text: str = "text", least: int = 0) -> str:
    """Rows (r, start, end, value) of a pattern's matches in SQL."""
    quoted = pattern.replace("'", "''")
    return f"""
        SELECT r, CAST(e - length(m[i]) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v[i] AS v FROM (
            SELECT r, m, v, i, list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e FROM (
                SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                    SELECT r, regexp_extract_all({text}, '{quoted}') AS m, regexp_extract_all({text}, '{quoted}', {1 if not least else 2}) AS v,
                        string_split_regex({text}, '{quoted}') AS b FROM d
                )
            )
        ) WHERE length(v[i]) >= {least}"""


def oracle() -> str:
    """The query over ``documents`` in SQL, tests included."""
    token = f"({TOKEN})"
    cases = {i: " ".join(f"WHEN regexp_full_match(core, '{e[1]}') THEN '{e[i]}'" for e in ENCODINGS) for i in (0, 2)}

    def tail(z: str) -> str:
        return f"(2 / (1 + exp(least(abs({z}), 12) * (1.5976 + 0.070565992 * least(abs({z}), 12) * least(abs({z}), 12)))))"

    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
    ), base AS (
        SELECT r, s, e, 0 AS o, 'assign' AS kind FROM ({_sql_spans("assign", ASSIGN, least=LEAST_VALUE)})
        UNION ALL SELECT r, s, e, 1, 'access' FROM ({_sql_spans("access", f"({ACCESS})")})
        UNION ALL SELECT r, s, e, 2, 'hex' FROM ({_sql_spans("hex", f"({HEX})")})
    ), cores AS (
        SELECT r, s, e, rtrim(v, '=') AS core FROM ({_sql_spans("tokens", token)})
    ), named AS (
        SELECT *, length(core)::BIGINT AS n, CASE {cases[0]} ELSE '' END AS encoding, CASE {cases[2]} ELSE '' END AS alphabet FROM cores
    ), symbols AS (
        SELECT *, length(alphabet)::BIGINT AS a, list_transform(string_split(core, ''), lambda c: instr(alphabet, c)::BIGINT - 1) AS x FROM named WHERE alphabet <> ''
    ), counted AS (
        SELECT *, CAST(list_sum(list_transform(range(a), lambda i: len(list_filter(x, lambda v: v = i)) ** 2)) AS BIGINT) AS q,
            CAST(list_sum(list_transform(range(1, n), lambda i: CAST((x[i] < a // 2) <> (x[i + 1] < a // 2) AS INTEGER))) AS BIGINT) AS c,
            CAST(list_sum(x) AS BIGINT) AS s1, CAST(list_sum(list_transform(x, lambda v: v * v)) AS BIGINT) AS s2,
            CAST(list_sum(list_transform(range(n), lambda i: x[i + 1] * x[(i + 1) % n + 1])) AS BIGINT) AS s3
        FROM symbols
    ), tested AS (
        SELECT *, (a * q / n - n - (a - 1)) / sqrt(2 * (a - 1) * (n - 1) / n) AS z1, (c - (n - 1) / 2) / (sqrt(n - 1) / 2) AS z2,
            CASE WHEN n * s2 = s1 * s1 THEN 12 ELSE ((n * s3 - s1 * s1) / (n * s2 - s1 * s1) + 1 / (n - 1)) * (n - 1) * sqrt(n - 2) / n END AS z3,
            (q - n - {SQUARES} * n * (n - 1)) / sqrt(2 * n * (n - 1) * ({SQUARES} - {SQUARES**2}::DOUBLE) + 4 * n * (n - 1) * (n - 2) * ({CUBES} - {SQUARES**2}::DOUBLE)) AS z4
        FROM counted
    ), chances AS (
        SELECT *, -ln({tail("z1")}) - ln({tail("z2")}) - ln({tail("z3")}) AS u, greatest(least(z4, 12), -12) AS z,
            CASE WHEN encoding = 'hex' THEN {IN_HEX} ** n ELSE 1 END AS h
        FROM tested
    ), weighed AS (
        SELECT *, exp(-u) * (1 + u + u * u / 2) AS random, h / (1 + exp(-z * (1.5976 + 0.070565992 * z * z))) * avg(n) OVER (PARTITION BY r) / n AS w FROM chances
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY r ORDER BY w) AS i, count(*) OVER (PARTITION BY r) AS m FROM weighed
    ), cut AS (
        SELECT *, max(CASE WHEN w <= {LEVEL} * i / m THEN w ELSE -1 END) OVER (PARTITION BY r) AS cut FROM ranked
    ), every AS (
        SELECT * FROM base UNION ALL SELECT r, s, e, 3, 'random' FROM cut WHERE w <= cut AND random >= {LEAST_RANDOM}
    ), listed AS (
        SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
            string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
        FROM every GROUP BY r
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN listed USING (r)
    """
