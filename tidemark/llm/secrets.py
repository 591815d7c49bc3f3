"""Secret scans: fixed patterns, and high entropy in long unbroken strings
(DataFrame functions only).

A candidate is a run of 20 or more characters of keys and tokens.  A window of
``WINDOW`` characters slides over it; the counts of its characters are carried
from one place to the next (one comes in, one goes out), and with them the sum
``s`` of ``c * log2(c)``, so the Shannon entropy ``log2(WINDOW) - s / WINDOW``
costs a few operations a step.  Hexadecimal strings, strings of letters and
digits, and strings of letters alone have thresholds of their own.  Candidates
are sought in what the fixed patterns leave of a text, so a span beside one is
scanned too.  An allow list suppresses candidates that as a whole have a
harmless form; a harmless part saves none.

All work is within a row; the table is read once and nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, upto

#: Fixed forms: kind, pattern, capture group that must be long enough, its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # whole runs, as [0-9a-f]+ with the short ones dropped
)
#: Where a text has none of this, its kind needs no look.
HINT = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes: kind, form of the whole candidate, alphabet, least entropy in bits.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", "0123456789abcdef", 2.9),
    ("entropy_base64", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 3.7),
    # long names in mixed case repeat letters: 4.0 bits and more need 17 different ones or so of 20
    ("entropy_letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-=", 4.0),
)
#: Forms of a whole candidate that are harmless: UUIDs, dates and numbers, placeholder words, subresource
#: hashes, lower-case paths of short names, runs of the alphabet and of digits.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[0-9_+/=-]+$",
    r"^(?i:example|placeholder|changeme|dummy|your|my|sample|test|api|access|secret|private|key|token|password|value|here|x{3,}|[0-9_+/=-])+$",
    r"^sha(1|256|384|512)-[A-Za-z0-9+/]+={0,2}$",
    r"^/?([a-z][a-z0-9_-]{0,15}/)+[a-z0-9_-]{0,16}$",
    r"^(?i:abcdefghij[k-z]*|klmnopqrst[u-z]*|0123456789|1234567890|[_+/=-])+$",
)
KINDS = [b[0] for b in BASE] + [c[0] for c in CLASSES]


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start,end,value>>``: the leftmost matches that do not
    overlap, in code points with the end exclusive; ``value`` is the group."""
    gaps, all_ = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else all_

    def placed(x):
        step = lambda s, i: let(s["at"] + F.length(F.get(x["gaps"], i)), lambda begin: F.struct(
            (begin + F.length(F.get(x["all"], i))).alias("at"),
            F.concat(s["out"], F.array(F.struct(begin.alias("start"), (begin + F.length(F.get(x["all"], i))).alias("end"), F.get(x["value"], i).alias("value")))).alias("out")))
        empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.aggregate(F.transform(upto(F.size(x["all"])), lambda i: i - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])

    return let(F.struct(gaps.alias("gaps"), all_.alias("all"), value.alias("value")), placed)


def least_sum(string: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The smallest ``sum(c * log2(c))`` of any window of the string, by
    incremental counts; null if it is shorter than a window."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def scan(codes):
        def step(s, i):
            new, old = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(-1)

            def moved(c):
                came, went = F.get(c, new), F.get(c, old)
                total = s["s"] + F.when(new == old, 0.0).otherwise(
                    F.get(weight, came + 1) - F.get(weight, came) + F.when(old >= 0, F.get(weight, went - 1) - F.get(weight, went)).otherwise(0.0))
                counts = F.transform(c, lambda x, j: x + F.when(j == new, 1).otherwise(0) - F.when(j == old, 1).otherwise(0))
                return F.struct(counts.alias("c"), total.alias("s"), F.when(i >= window - 1, F.least(s["least"], total)).otherwise(s["least"]).alias("least"))

            return let(s["c"], moved)

        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("c"), F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("least"))
        return F.aggregate(F.transform(upto(F.size(codes)), lambda i: i - 1), zero, step, lambda s: s["least"])

    codes = F.transform(F.split(string, ""), lambda ch: F.call_function("instr", F.lit(alphabet), ch) - 1)
    return let(codes, scan)


def _base(text: Column, kind: int) -> Column:
    name, pattern, group, least = BASE[kind]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = F.transform(F.filter(located(text, pattern, group), lambda m: F.length(m["value"]) >= least),
                        lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    return F.when(text.rlike(HINT[name]), found).otherwise(none)


def _masked(text: Column, base: Column) -> Column:
    """The text with spaces in place of its base spans."""
    def step(s, b):
        begin = F.greatest(b["start"], s["at"])
        kept = F.substr(text, s["at"] + 1, F.greatest(begin - s["at"], F.lit(0)))
        return F.struct(F.greatest(b["end"], s["at"]).alias("at"), F.concat(s["out"], kept, F.repeat(F.lit(" "), F.greatest(b["end"] - begin, F.lit(0)))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(F.array_sort(base), start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return F.when(F.size(base) == 0, text).otherwise(whole)


def _entropic(text: Column, base: Column) -> Column:
    """Candidates of high entropy that are not allowed, outside of base spans."""
    def verdict(m):
        kind = F.lit(None).cast("int")
        for i, (_, form, alphabet, bits) in reversed(list(enumerate(CLASSES))):
            value = F.lower(m["value"]) if i == 0 else m["value"]
            high = least_sum(value, alphabet) <= WINDOW * (math.log2(WINDOW) - bits) + 1e-9
            kind = F.when(m["value"].rlike(form), F.when(high, F.lit(len(BASE) + i))).otherwise(kind)
        return F.struct(m["start"].alias("start"), kind.alias("kind"), m["end"].alias("end"))

    allowed = lambda m: m["value"].rlike("|".join(f"(?:{a})" for a in ALLOW))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = let(_masked(text, base), lambda t: F.filter(F.transform(F.filter(located(t, CANDIDATE), lambda m: ~allowed(m)), verdict), lambda s: s["kind"].isNotNull()))
    return F.when(text.rlike(CANDIDATE), found).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secret_scan(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text``) and ``n_assign, n_access, n_hex, base_sha256,
    spans``: every span as ``kind:start:end`` in code points, by start, then
    kind in the order of ``KINDS``.

    * null and empty texts have no span (the hash is that of an empty string);
    * repeated rows give repeated rows, an empty table an empty result;
    * an input column named like an output column is replaced.
    """
    out = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    cols = [c for c in docs.columns if c not in out]
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(*cols, *[_base(text, i).alias(f"_b{i}") for i in range(len(BASE))])
    parts = parts.withColumn("_base", F.concat("_b0", "_b1", "_b2"))
    parts = parts.withColumn("_more", let(F.col("_base"), lambda b: _entropic(text, b)))
    return parts.select(*cols, *[F.size(f"_b{i}").cast("long").alias(f"n_{BASE[i][0]}") for i in range(len(BASE))],
                        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.concat("_base", "_more")).alias("spans"))
