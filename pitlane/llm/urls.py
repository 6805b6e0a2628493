"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is a regular expression over a URL's normal form (host, A-Z lower-cased, then path) with the
literal tokens that any match must contain. Rules are filed under the one of their tokens that the
fewest URLs contain, counted over all URLs. A URL's own tokens fetch its candidate rules by a join,
and only those run their regular expression.

Rules of a host and a path fit the host and its subdomains; the longest that fits decides. Where none
does, a URL that any pattern rule matches is blocked, and any other is allowed.

Rules come from tuples (LISTED, PATTERNS) or from files (read_rules), and are a table in either case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ROW_OVERHEAD, cut, small

_TOKEN = r"[a-z0-9]+"
_RULES = "id long, name string, pattern string, tokens array<string>, verdict string, weight int, listed boolean"
_ARROW = pa.schema([("name", pa.string()), ("pattern", pa.string()), ("tokens", pa.list_(pa.string())), ("verdict", pa.string()), ("weight", pa.int32()), ("listed", pa.bool_())])


@dataclass(frozen=True)
class Rule:
    """name: what is reported. pattern: for rlike, over host and path. tokens: lower-case literals of any match. weight: the highest decides."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int
    listed: bool


def host_rule(verdict: str, rule: str) -> Rule:
    """Of ``host/path``: the host and its subdomains, if the URL's path starts with ``/path``."""
    host, _, path = rule.partition("/")
    whole = re.findall(_TOKEN, path.lower())
    # the last token of a path may be the beginning of a longer one; those before it are whole
    sure = whole if re.search(r"[^A-Za-z0-9]$", path) else whole[:-1]
    quoted = "".join(c if re.match(r"[A-Za-z0-9/]", c) else f"\\x{{{ord(c):x}}}" for c in f"{host.lower()}/{path}")
    return Rule(rule, rf"^(?:[^/]*\.)?{quoted}", (*re.findall(_TOKEN, host.lower()), *sure), verdict, len(rule), True)


def pattern_rule(literals: str, pattern: str | None = None) -> Rule:
    """Blocks what matches ``pattern`` (by default the literals themselves as whole tokens of the host or path)."""
    body = pattern or r"(?i)(?<![A-Za-z0-9])" + re.sub(r"[^A-Za-z0-9]", lambda m: f"[{m[0]}_]" if m[0] == "-" else f"\\{m[0]}", literals) + r"(?![A-Za-z0-9])"
    return Rule(literals, body, tuple(re.findall(_TOKEN, literals.lower())), "block", 0, False)


#: The listed rules.
LISTED = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)
#: Words that block what has them as whole tokens, a hyphen standing for an underscore too.
BLOCKED_WORDS = (
    "adult", "adult-chat", "adult-dating", "cams", "camgirls", "escort-girls", "hardcore", "hentai", "live-sex", "milf", "nsfw", "nude-pics", "porn", "pornstar", "sex-toys", "webcam-girls", "xxx",
    "bet-online", "bingo-online", "blackjack", "casino", "free-spins", "jackpot-slots", "online-betting", "poker-online", "roulette", "slot-machines", "sports-betting",
    "buy-cialis", "buy-viagra", "cheap-meds", "cheap-pills", "no-prescription", "online-pharmacy", "weight-loss-pills",
    "cash-advance", "get-rich-quick", "instant-loan", "make-money-fast", "payday-loans", "work-from-home-jobs",
    "cracked-software", "free-keygen", "keygen", "nulled-scripts", "serial-keys", "torrent", "torrents", "warez",
    "essay-writing-service", "free-ringtones", "replica-watches", "spam-farm", "seo-backlinks", "link-farm", "buy-followers",
    "account-verify", "malware", "phishing", "scareware", "verify-your-account",
)
#: Expressions, each with literals of any match: ad and click servers, calendars and listings without end, session traps.
BLOCKED_EXPRESSIONS = (
    ("doubleclick net", r"^(?:[^/]*\.)?doubleclick\.net(?:/|$)"),
    ("adserver", r"^adserver\."),
    ("wp login php", r"/wp-login\.php$"),
    ("cgi bin", r"/cgi-bin/"),
    ("phpsessid", r"(?i);phpsessid="),
    ("jsessionid", r"(?i);jsessionid="),
    ("calendar", r"/calendar/(?:[0-9]{4}/){2,}"),
    ("page", r"(?:/page/[0-9]+){2,}"),
)
PATTERNS = (*map(pattern_rule, BLOCKED_WORDS), *(pattern_rule(*x) for x in BLOCKED_EXPRESSIONS))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(subject), F.lit(_TOKEN), F.lit(0)))


def rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(i, r.name, r.pattern, list(r.tokens), r.verdict, r.weight, r.listed) for i, r in enumerate(rules)], _RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rules table of text files with a rule a line; empty lines and those that begin with ``#`` are none.

    ``allow host/path`` or ``block host/path``: a listed rule. ``block-words some-words``: a pattern of
    these words as whole tokens. ``block-regex literals of any match <tab> expression``: a pattern of its own.
    Lines are parsed where they lie, whatever their number. Any other line is an error.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')").distinct()

    def run(batches):
        for b in batches:
            out = [_parsed(x) for x in b.column("line").to_pylist()]
            yield pa.RecordBatch.from_pylist([{"name": r.name, "pattern": r.pattern, "tokens": list(r.tokens), "verdict": r.verdict, "weight": r.weight, "listed": r.listed} for r in out], schema=_ARROW)

    return lines.mapInArrow(run, _RULES.removeprefix("id long, ")).select(F.monotonically_increasing_id().alias("id"), "*")


def _parsed(line: str) -> Rule:
    kind, _, rest = line.partition(" ")
    if kind in ("allow", "block") and "/" in rest:
        return host_rule(kind, rest.strip())
    if kind == "block-words" and rest.strip():
        return pattern_rule(rest.strip())
    literals, tab, expression = rest.partition("\t")
    if kind == "block-regex" and tab and expression.strip():
        return pattern_rule(literals.strip(), expression.strip())
    raise ValueError(f"no rule: {line}")


def judge(df: DataFrame, url: str = "url", rules: DataFrame | None = None) -> DataFrame:
    """``df`` with host, path, rule (of the listed ones, or null), pattern (of the others, or null) and verdict added.

    rules: as rules_table() or read_rules() makes them. A rule without a token is tried on every URL.
    Of listed rules that fit and are equally long the one greatest by name decides, of patterns that
    match the first by name is reported. A rule's tokens must be whole ones (runs of letters and digits)
    of any match. A null URL, an empty one or one without ``://`` has an empty
    host and path, no rule, and is allowed. Repeated rows stay and get the same result; URLs are of any
    length. Columns of ``df`` named as an added one are replaced; all others stay. An empty table gives
    an empty one.
    """
    rules = rules_table(df.sparkSession, LISTED + PATTERNS) if rules is None else rules
    rules = cut(rules)
    df = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    subjects = cut(df.select("host", "path").where("host != ''").distinct())
    every = F.array(F.lit(""))  # the token of rules without one
    fetched = subjects.select("host", "path", F.explode(F.concat(_tokens(F.concat("host", "path")), every)).alias("token"))

    filed = rules.select("id", F.explode(F.when(F.size("tokens") > 0, F.array_distinct("tokens")).otherwise(every)).alias("token"))
    counts = fetched.join(small(filed.select("token").distinct(), 40), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = filed.join(counts, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).where("r.n > 0")
    index = cut(rules.join(rarest, "id").select(F.col("r.token").alias("token"), "name", "pattern", "verdict", "weight", "listed"))
    size = index.agg(F.coalesce(F.sum(F.length("name") + F.length("pattern") + F.length("token") + 80 + ROW_OVERHEAD), F.lit(0)).alias("b")).first().b

    candidates = fetched.join(F.broadcast(index) if size <= BROADCAST_BYTES else index, "token")
    fits = candidates.where(F.expr("concat(host, path) rlike pattern"))
    found = fits.groupBy("host", "path").agg(
        F.max(F.when(F.col("listed"), F.struct("weight", "name", "verdict"))).alias("best"),
        F.min(F.when(~F.col("listed"), F.col("name"))).alias("pattern"),
    )
    found = found.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("best.name").alias("rule"), F.col("pattern"), F.coalesce("best.verdict", F.when(F.col("pattern").isNotNull(), "block")).alias("verdict"))
    out = df.drop("rule", "pattern", "verdict").join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").drop("_host", "_path")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
