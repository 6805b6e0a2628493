"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Everything is a DataFrame expression. Matches of a pattern alternate with the pieces that split()
leaves, so their places are running sums of lengths, in code points.

The entropy part looks at candidate strings, the longest runs of a class's characters. A window of
``WINDOW`` characters slides over a candidate; the count of the character that enters goes up, that of
the one that leaves goes down, and the sum of c * log2(c) over the counts changes by those two terms
alone. The window's entropy is log2(WINDOW) - sum / WINDOW. A candidate with a window at or above its
class's threshold is a span, unless the allow-list matches it or a base span covers it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 24

#: The base patterns, their kinds, and how many characters of which group they need.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|x{6,}|0{8,}|123456789|abcdefgh|qwerty",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Z][a-z]+(?:[A-Z][a-z]+)+[0-9]{0,4}$",
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of ``alphabet`` (given as text) of WINDOW or more that match every pattern of ``needs``."""

    kind: str
    alphabet: str
    fold_case: bool
    threshold: float
    needs: tuple[str, ...]

    @property
    def pattern(self) -> str:
        inside = "".join("\\" + c if c in "-+/_" else c for c in self.alphabet)
        inside += inside.upper() if self.fold_case else ""
        return f"(?<![{inside}])[{inside}]{{{WINDOW},}}"


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "abcdef", True, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharacterClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", False, 4.0, ("[0-9]", "[a-z]", "[A-Z]")),
)

_SPANS = "array<struct<kind:string,start:bigint,stop:bigint,found:string>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once: an array of one binds it to a name, where a plain expression would be made anew for each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, op) -> Column:
    """Of an array of longs (none below 0) what ``op`` makes of each and all before it.

    Chunks of about the root of the length are folded apart, so that no fold copies a long array.
    """

    def folded(chunk: Column, start: Column) -> Column:
        return F.slice(F.aggregate(chunk, F.array(start), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))), F.lit(2), F.size(chunk))

    def of(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), op))
        starts = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), folded))

    def chunked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return _bound(F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size)), of)

    return _bound(values, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(v))


def _placed(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All matches as spans; ``found`` is the text of ``group``."""

    def spans(m: Column) -> Column:
        gaps = F.transform(F.slice(m.gaps, F.lit(1), F.size(m.whole)), lambda g: F.length(g).cast("long"))
        sizes = F.transform(m.whole, lambda w: F.length(w).cast("long"))
        stops = _running(F.zip_with(gaps, sizes, lambda g, n: g + n), lambda a, b: a + b)
        found = m.whole if group == 0 else m.part
        ends = F.zip_with(stops, sizes, lambda stop, n: F.struct(F.lit(kind).alias("kind"), (stop - n).alias("start"), stop.alias("stop")))
        return F.zip_with(ends, found, lambda e, f: F.struct(e.kind.alias("kind"), e.start.alias("start"), e.stop.alias("stop"), f.alias("found")))

    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("gaps")]
    parts += [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")] * (group != 0)
    return F.when(text.rlike(pattern), _bound(F.struct(*parts), spans)).otherwise(F.array().cast(_SPANS))


def peak_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any window of the candidate (characters of the alphabet alone); null if it is shorter.

    Counts are packed into a few longs, so a step changes two of them.
    """
    bits = (window + 1).bit_length()
    per = 60 // bits
    term = F.array(*[F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(window + 2)])
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // per)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
    word, shift = lambda c: F.floor(c / per).cast("int"), lambda c: (c % per * bits).cast("int")

    def step(s: Column, x: Column) -> Column:
        count = lambda c: F.call_function("shiftright", F.get(s.counts, word(c)), shift(c)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        entering, leaving = count(x.enters), count(x.leaves)
        grown = F.get(term, entering + 1) - F.get(term, entering)
        total = s["sum"] + grown + F.when(x.leaves >= 0, F.get(term, leaving - 1) - F.get(term, leaving)).otherwise(0.0)
        one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
        counts = F.transform(s.counts, lambda c, k: c + F.when(k == word(x.enters), one(x.enters)).otherwise(0) - F.when((x.leaves >= 0) & (k == word(x.leaves)), one(x.leaves)).otherwise(0))
        same = x.leaves == x.enters
        total = F.when(same, s["sum"]).otherwise(total)
        return F.struct(F.when(same, s.counts).otherwise(counts).alias("counts"), total.alias("sum"), F.when(x.i >= window - 1, F.least(s.least, total)).otherwise(s.least).alias("least"))

    def peak(place: Column) -> Column:
        steps = F.transform(place, lambda c, i: F.struct(c.alias("enters"), F.when(i >= window, F.get(place, i - window)).otherwise(-1).alias("leaves"), i.alias("i")))
        return F.aggregate(steps, start, step, lambda s: F.when(s.least < float("inf"), F.round(math.log2(window) - s.least / window, 9)))

    return _bound(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1), peak)


def _long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s.found) >= least)


def _random(spans: Column, c: CharacterClass, allowed: tuple[str, ...]) -> Column:
    """Those candidates of a class that look random and aren't allowed."""

    def passes(s: Column) -> Column:
        ok = F.lit(True)
        for need in c.needs:
            ok = ok & s.found.rlike(need)
        for pattern in allowed:
            ok = ok & ~s.found.rlike(pattern)
        return ok

    mixed = F.filter(spans, passes)
    return F.filter(mixed, lambda s: peak_entropy(F.lower(s.found) if c.fold_case else s.found, c.alphabet) >= c.threshold)


def scan(df: DataFrame, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``df`` with two more columns, arrays of struct kind, start, stop: the base spans, and all spans.

    Both are sorted by start, then by kind: assign, access, hex, then the entropy classes in their
    order. Places are code points of the whole text, the stop is exclusive. Spans of different kinds
    may overlap; one of an entropy class never lies inside a base span. A null or empty text has no
    spans. Repeated rows stay. Columns of ``df`` named as the two outputs are replaced; all others stay.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    fixed = [_long_enough(_placed(t, pattern, kind, group), least) for kind, pattern, group, least in BASE]
    added = [_random(_placed(t, c.pattern, c.kind), c, allowed) for c in classes]
    kinds = [k for k, *_ in BASE] + [c.kind for c in classes]
    rank = F.array(*[F.lit(k) for k in kinds])

    def ordered(a: Column) -> Column:
        keyed = F.array_sort(F.transform(a, lambda s: F.struct(s.start.alias("start"), F.array_position(rank, s.kind).alias("rank"), s.stop.alias("stop"), s.kind.alias("kind"))))
        return F.transform(keyed, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop")))

    out = df.withColumn(base, ordered(F.concat(*fixed)))
    extra = F.concat(*added) if added else F.array().cast(_SPANS)
    known = _bound(F.struct(F.col(f"{base}.start").alias("starts"), _running(F.col(f"{base}.stop"), lambda a, b: F.greatest(a, b)).alias("stops"), extra.alias("extra")), lambda k: F.filter(k.extra, lambda s: ~_inside(s, k.starts, k.stops)))
    return out.withColumn(spans, ordered(F.concat(F.transform(F.col(base), lambda s: s.withField("found", F.lit(""))), known)))


def _inside(span: Column, starts: Column, stops: Column) -> Column:
    """Whether a span lies inside one of those of sorted ``starts``; stops: the greatest stop up to each. By binary search."""
    at = F.aggregate(F.array(*[F.lit(1 << p) for p in range(30, -1, -1)]), F.lit(0), lambda at, p: F.when((F.size(starts) - at >= p) & (F.get(starts, at + p - 1) <= span.start), at + p).otherwise(at))
    return F.coalesce(F.get(stops, at - 1) >= span.stop, F.lit(False))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with what the sorted spans cover replaced, overlapping spans by one mark; a null text stays null."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s.at + 1).cast("int"), F.greatest(x.start - s.at, F.lit(0)).cast("int"))
        covered = (x.start < s.at) & (s.at > 0)
        return F.struct(F.greatest(s.at, x.stop).alias("at"), F.when(covered, s.out).otherwise(F.concat(s.out, gap, F.lit(mark))).alias("out"))

    rest = F.aggregate(spans, start, step, lambda s: F.concat(s.out, F.substring(text, (s.at + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
