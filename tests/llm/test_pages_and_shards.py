"""HTML extraction, URL filters and sharding on small tables, edge cases included."""

import random
import re
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from pitlane.llm import oracles, queries, urls, wrappers
from pitlane.llm.shards import ShardStore, load_in_arrivals

from ..compare import connect, same
from ..conftest import SF

MENU = "<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>Topics</a></li></ul></nav>"
FOOT = "<aside><h3>Read more</h3><p>Sidebar words</p></aside><footer><p>All rights reserved</p></footer></body></html>"


def page(*blocks):
    return f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{MENU}<article>{''.join(f'<p>{b}</p>' for b in blocks)}</article>{FOOT}"


def test_article_without_its_frame(spark):
    rows = [(i, f"https://a.example/{i}", page(f"First  part\n of {i} &amp; more", "Second <b>bold</b> part" * (i % 3 + 1))) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_texts(df, ["page_id"]).collect()}
    assert got == {i: f"First part of {i} & more " + "Second bold part" * (i % 3 + 1) for i in range(12)}


def test_boilerplate_without_telling_tags(spark):
    """Constant text of a host is template, also in a repeated part and in an optional one; copies and single pages prove nothing."""
    menu = "<div><p>Start here</p></div><div><ul><li>Cars</li><li>Boats</li></ul></div>"
    plain = lambda i, extra="": f"<html><body>{menu}{extra}<div><p>Story {i} begins</p><p>and ends {i}</p></div><div><p>Our company since 1990</p></div></body></html>"
    optional = "<section><p>Try our paper</p></section>"
    rows = [(i, f"https://a.example/{i}", plain(i, optional if i % 4 == 0 else "")) for i in range(16)]
    rows += [(100 + i, "https://copies.example/", plain(7)) for i in range(8)] + [(200, "https://one.example/", plain(8))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in wrappers.main_texts(df, ["page_id"]).collect()}
    assert {i: got[i] for i in range(16)} == {i: f"Story {i} begins and ends {i}" for i in range(16)}
    whole = "Start here Cars Boats Story {0} begins and ends {0} Our company since 1990"
    assert all(got[100 + i] == whole.format(7) for i in range(8)) and got[200] == whole.format(8)


def as_regex(nodes):
    """The wrapper as a regular expression over its tokens, each closed by a space."""
    return "".join(re.escape(x + " ") if isinstance(x, str) else f"(?:{as_regex(x[1])}){x[0]}" for x in nodes)


def random_tree(rng, depth):
    out = []
    for _ in range(rng.randint(0, 4)):
        name = rng.choice("abc")
        out += ["#"] if depth == 0 or rng.random() < 0.3 else [f"<{name}", *random_tree(rng, depth - 1), f"</{name}"]
    return out


@pytest.mark.parametrize("pairs", [wrappers.TABLE_PAIRS, 0])
def test_wrappers_match_all_their_pages(monkeypatch, pairs):
    """Whatever the pages and the alignment, the union-free expression accepts each page that it was made of, and folding its parts does so too."""
    monkeypatch.setattr(wrappers, "TABLE_PAIRS", pairs)
    rng = random.Random(21)
    for _ in range(150):
        pages = [random_tree(rng, 3) for _ in range(4)]
        parts = [wrappers.joined(wrappers.joined(None, a), b) for a, b in (pages[:2], pages[2:])]
        for w in (*parts, wrappers.joined(*parts)):
            mine = pages[:2] if w is parts[0] else pages[2:] if w is parts[1] else pages
            for p in mine:
                assert re.fullmatch(as_regex(w), "".join(t + " " for t in p))


@pytest.mark.parametrize("pairs", [wrappers.TABLE_PAIRS, 0])
def test_alignment_is_as_long_as_can_be(monkeypatch, pairs):
    """The longest common sequence, against trying all of them; by a table and by bits."""
    monkeypatch.setattr(wrappers, "TABLE_PAIRS", pairs)
    rng = random.Random(5)
    for _ in range(300):
        xs, ys = ([rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(2))
        of = lambda v: {tuple(v[i] for i in range(len(v)) if mask >> i & 1) for mask in range(1 << len(v))}
        got = wrappers._common(xs, ys)
        assert [xs[i] for i, _ in got] == [ys[j] for _, j in got] and len(got) == max(map(len, of(xs) & of(ys)))
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_long_levels_are_aligned_exactly():
    rng = random.Random(6)
    xs, ys = ([rng.choice("abcdef") for _ in range(n)] for n in (900, 700))
    row = [0] * (len(ys) + 1)
    for x in xs:
        new = [0]
        for j, y in enumerate(ys):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    got = wrappers._common(xs, ys)
    assert [xs[i] for i, _ in got] == [ys[j] for _, j in got] and len(got) == row[-1]


def texts_of(spark, sources, host="https://a.example/", parts=3):
    df = spark.createDataFrame([(i, f"{host}{i}", s) for i, s in enumerate(sources)], "page_id long, url string, html string").repartition(parts)
    return [r.text for r in wrappers.main_texts(df, ["page_id"]).orderBy("page_id").collect()]


def test_articles_keep_what_other_pages_have_too(spark):
    """A byline, a closing line and a body that several pages of the host carry are theirs."""
    body = "".join(f"<p>Paragraph {j} of a syndicated story.</p>" for j in range(4))
    plain = "Paragraph 0 of a syndicated story. Paragraph 1 of a syndicated story. Paragraph 2 of a syndicated story. Paragraph 3 of a syndicated story."
    article = [f"<body>{MENU}<article><h1>Title {i}</h1><p>By Jane Roe</p>{body}<p>Read on.</p></article>{FOOT}" for i in range(6)]
    assert texts_of(spark, article) == [f"Title {i} By Jane Roe {plain} Read on." for i in range(6)]
    division = [f"<body><div><p>Our menu</p></div><div id=content><h1>Title {i}</h1>{body}</div><div><p>Since 1990</p></div></body>" for i in range(6)]
    assert texts_of(spark, division) == [f"Title {i} {plain}" for i in range(6)]


def test_wrappers_of_a_host_fold_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    sources = [f"<body><div><p>Menu</p></div><div><h1>Title {i}</h1>{'<p>x</p>' * (i % 4)}</div></body>" for i in range(24)]
    assert texts_of(spark, sources, parts=9) == [" ".join([f"Title {i}", *["x"] * (i % 4)]) for i in range(24)]


def random_page(rng, i, frame):
    """A page and its main text: an article in one of several markups within a host's frame, whose furniture varies."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    blocks = [f"Title {i} {line(3)}"] + [line(rng.randint(5, 30)) for _ in range(rng.randint(1, 8))]
    inner = f"<h1>{blocks[0]}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p class='lead'>{}</p>", "<blockquote>{}</blockquote>", "<div class='alert'>{}</div>", "<p><b>{}</b></p>", "<div class=form>{}</div>"]).format(b) for b in blocks[1:])
    furniture = [f"<aside><article>{line(6)}</article></aside>", f"<div class='ad_wrapper_300x250'>{line(4)}</div>", f"<div class='js-ad'>{line(4)}</div>", f"<section id=comments><article class='comment'>{line(9)}</article></section>", f"<div class='cookie-notice'>{line(4)}</div>", f"<form><label>{line(2)}</label></form>", f"<ul class=menu><li>{word()}</li></ul>", f"<article class='comment'><p>{line(5)}</p></article>"]
    some = rng.sample(furniture, rng.randint(0, 4))
    holder = {"article": f"<article>{inner}</article>", "main": f"<main class=content>{inner}</main>", "div": f"<div id=content>{inner.replace(chr(39) + 'alert' + chr(39), 'x').replace('class=form', '')}</div>"}[frame]
    at = rng.randint(0, len(some))
    return f"<html><body>{MENU}<div><p>Welcome to our site</p></div>{''.join(some[:at])}{holder}{''.join(some[at:])}<div><p>Call us</p></div>{FOOT}", " ".join(blocks)


@pytest.mark.parametrize("frame", ["article", "main", "div"])
def test_generated_hosts(spark, frame):
    rng = random.Random(17)
    pages = [random_page(rng, i, frame) for i in range(40)]
    assert texts_of(spark, [p for p, _ in pages]) == [t for _, t in pages]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<div id=content><h1>Title</h1><p>The story itself.</p></div><aside><article>A related piece</article></aside>", "Title The story itself."),
        ("<div id=content><h1>Title</h1><p>The story itself.</p></div><article><p>Card</p></article>", "Title The story itself. Card"),
        ("<article><p>The story.</p><article class='comment'>Reader says</article></article><article class='comment'>Another</article>", "The story."),
        ("<article><p>The story.</p><div class='ad_wrapper_300x250'>Buy now</div><div class='js-ad'>Buy</div></article>", "The story."),
        ("<article><div class='alert'>Storm alert text</div><div class='form'>of verse</div><form><label>Name</label></form></article>", "Storm alert text of verse"),
        ("<article><div class='article-header'><h1>Title</h1></div><p>Text</p></article>", "Title Text"),
        ("<article><div class='notice-board'>Kept one</div><section class='related-work'>Kept two</section><div class='related-posts'>no</div><p>Then <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>", "Kept one Kept two Then x=1"),
        ("<div class='siteHeader'>no</div><div><a>Home</a><a>About</a></div><ul><li><a>One</a></li><li><a>Two</a></li></ul><div><p>Story with a <a>link</a></p><p><a>A line of its own</a></p></div><div id='ad-slot-2'>no</div>", "Story with a link A line of its own"),
        ("<article><header><h1>Title</h1></header><p>Body &amp; soul</p><ul><li><a>Source</a></li></ul><div class='comments'><p>no</p></div><button>no</button></article><main><p>More</p></main>", "Title Body & soul Source More"),
        ("<article>" + "<div>" * 3_000 + "deep" + "</div>" * 3_000 + "<p>after</p></article>", "deep after"),
        ("<article>" + "<p>a</p><div>b</div>" * 4_000 + "</article>", ("a b " * 4_000).strip()),
    ],
)
def test_main_text_of_odd_pages(source, expected):
    page = wrappers.Page(source)
    w = wrappers.joined(wrappers.joined(None, page.tokens), wrappers.Page("<div><p>x</p></div>" * 2_000).tokens)
    assert wrappers.extract(source, wrappers.compiled(w), set()) == expected


def test_pages_edges(spark):
    rows = [(1, None, page("Only words here")), (2, "https://b.example/", None), (3, "https://b.example/", ""), (None, "no host", page("Twice")), (None, "no host", page("Twice")), (5, "https://b.example/z", "<p"), (6, "https://c.example/", page("long " * 60_000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("w", F.lit(0)).withColumn("text", F.lit("x")).withColumn("host", F.lit("h"))
    got = Counter((r.page_id, r.text) for r in wrappers.main_texts(df, ["page_id"]).collect())
    assert got[None, "Twice"] == 2 and got[1, "Only words here"] == 1 and got[2, ""] == 1 and got[3, ""] == 1
    assert got[6, ("long " * 60_000).strip()] == 1 and sum(got.values()) == 7
    assert wrappers.main_texts(df.limit(0), ["page_id"]).count() == 0


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        (None, ("", "", None, "allow")),
        ("nothing", ("", "", None, "allow")),
        ("https://example.com/en/a?b#c", ("example.com", "/en/a", "example.com/en/", "block")),
        ("https://www.EXAMPLE.com/en/a", ("www.example.com", "/en/a", "www.example.com/en/", "allow")),
        ("https://example.com", ("example.com", "", None, "allow")),  # no path, so none that starts with /
        ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
        ("http://site.net/es/1", ("site.net", "/es/1", "net/es/", "block")),
    ],
)
def test_host_rules(spark, url, expected):
    row = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (row.host, row.path, row.rule, row.verdict) == expected


def brute_verdicts(urls_, lines):
    """Every rule tried on every URL."""
    hosts = [(k, r) for k, _, r in (x.partition(" ") for x in lines) if k in ("allow", "block")]
    words = [r for k, _, r in (x.partition(" ") for x in lines) if k == "block-words"]
    regexes = [tuple(r.split("\t")) for k, _, r in (x.partition(" ") for x in lines) if k == "block-regex"]
    patterns = [(w, re.compile(r"(?i)(?<![a-z0-9])" + w.replace("-", "[-_]") + r"(?![a-z0-9])")) for w in words] + [(a, re.compile(b)) for a, b in regexes]
    out = []
    for url in urls_:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), r, k) for k, r in hosts if host and (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        best = max(fits, default=None)
        found = min((n for n, p in patterns if host and p.search(host + path)), default=None)
        out.append((url, host, path, best and best[1], found, best[2] if best else "block" if found is not None else "allow"))
    return out


def test_thousands_of_rules_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    host = lambda: ".".join([*rng.sample(words, rng.randint(1, 2)), rng.choice(["com", "net", "org"])])
    lines = {f"{rng.choice(['allow', 'block'])} {h}/{rng.choice(['', 'a/', 'a', 'b/c/', 'W1'])}" for h in (host() for _ in range(1500))}
    lines = {next(x for x in sorted(lines) if x.partition(" ")[2] == r) for r in {x.partition(" ")[2] for x in lines}}  # one verdict a rule
    lines |= {f"block-words {'-'.join(rng.sample(words, rng.randint(1, 3)))}" for _ in range(800)}
    lines |= {f"block-regex {w} end\t/{w}/[0-9]+/end$" for w in rng.sample(words, 100)} | {"block-regex \t/[0-9]{5}$", "block net/"}
    (tmp_path / "rules.txt").write_text("# a list\n\n" + "\n".join(sorted(lines)) + "\n" + sorted(lines)[0] + "\n")
    made = [f"http{rng.choice(['', 's'])}://{host()}{rng.choice(['', '/', '/a/', '/ab', '/b/c/', '/W1x', '/12345', '?a=w3', '#w4'])}{rng.choice(['', '/'.join(rng.sample(words, 2)), '_'.join(rng.sample(words, 3)), rng.choice(words) + '/12/end'])}" for _ in range(400)]
    made += [made[0], None, "", "x", "http://", "https://W1.COM/A", "http://é.com/ü?x", "http://w1.com/" + "w2/" * 20_000]
    rows = spark.createDataFrame([(i, u, "x", 3) for i, u in enumerate(made)], "page_id long, url string, rule string, token int")
    got = urls.judge(rows, rules=urls.read_rules(spark, str(tmp_path / "rules.txt"))).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.pattern, r.verdict) for r in got] == brute_verdicts(made, sorted(lines)) and got[0].token == 3
    assert len({r.verdict for r in got if r.rule}) == 2 and sum(r.pattern is not None for r in got) > 20
    assert urls.judge(rows.limit(0)).count() == 0
    (tmp_path / "bad.txt").write_text("deny all\n")
    with pytest.raises(Exception, match="no rule: deny all"):
        urls.read_rules(spark, str(tmp_path / "bad.txt")).collect()


def test_own_rules_and_sql(spark):
    lines = [*(f"{r.verdict} {r.name}" for r in urls.LISTED), *(f"block-words {w}" for w in urls.BLOCKED_WORDS), *(f"block-regex {a}\t{b}" for a, b in urls.BLOCKED_EXPRESSIONS)]
    made = ["http://ads.doubleclick.net/x", "http://doubleclick.network/", "http://adserver.a.org/", "http://a.org/wp-login.php", "http://a.org/cgi-bin/x", "http://a.org/x;PHPSESSID=1", "http://a.org/calendar/2020/2021/", "http://a.org/page/1/page/2", "http://a.org/online_pharmacy/", "http://casino.org", "http://casinos.org", "http://a.org/adult", "http://example.com/en/porn"]
    rows = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = [(r.url, r.host, r.path, r.rule, r.pattern, r.verdict) for r in urls.judge(rows).orderBy("page_id").collect()]
    assert got == brute_verdicts(made, lines) and sum(g[5] == "block" for g in got) == 11


@pytest.mark.parametrize("name", ["op2_url_filter", "op9_minhash_near_dedup", "op10_decontamination"])
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), connect(SF), oracles.SQL[name])


def test_shards_keep_every_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    long = spark.createDataFrame([(10**9, "x" * 3_000_000, "en", "web", 3_000_000)], docs.schema)
    rows = docs.unionByName(extra).unionByName(docs.limit(5)).unionByName(long).withColumns({"run": F.lit("r"), "file_": F.lit(1), "ARRIVAL": F.lit(7)})
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 20, base_bytes=1 << 12, fan_in=2)
    got = load_in_arrivals(store, rows, "doc_id", arrivals=5)
    assert {"run", "run_", "file", "file_"} <= set(got.columns)
    got = got.select(rows.columns)
    assert got.exceptAll(rows).count() == 0 and rows.exceptAll(got).count() == 0
    # every version is there: the first has the lowest ids and the null ones
    first = store.snapshot(1).agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    assert first[0] < 200 and first[1] == 3 and len(store.versions()) > 5


def test_compaction_by_size(spark, tmp_path):
    """Runs of one tier are merged, others are left; versions tell what was when, and a young run without a version outlives vacuum()."""
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 14, base_bytes=1 << 10, fan_in=3)
    noise = lambda n, seed: spark.range(n).select(F.xxhash64("id", F.lit(seed)).alias("x")).coalesce(1)
    store.append(noise(20_000, 0))
    large = store.runs()
    for i in range(1, 4):
        store.append(noise(300, i))
    before, version = {run for run, _, _ in store.runs()}, store.versions()[-1]
    store.compact()
    after = {run: tier for run, tier, _ in store.runs()}
    assert large[0][0] in after and len(after) == 2 and len(before) == 4 and store.snapshot().count() == 20_900
    tier, small = large[0][1], min(t for _, t, _ in store.runs(version))
    assert sorted(after.values()) == sorted([tier, small + 1]) and {run for run, _, _ in store.runs(version)} == before
    store.append(noise(6_000, 9))
    merged = store._write(noise(4_000, 10), 99)
    assert store.vacuum() == 0 and merged.count() == 1 and len(store.versions()) == 1
    assert store.vacuum(older_than=timedelta(0)) == 4 and store.snapshot().count() == 26_900


def test_compacted_files_are_of_target_size(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"), target_bytes=1 << 16, base_bytes=1 << 10, fan_in=4)
    load_in_arrivals(store, spark.range(60_000).select(F.xxhash64("id").alias("x")).repartition(3), "x", arrivals=4)
    files = [r.bytes for r in store.manifest().collect()]
    assert len(files) > 2 and all(0.5 < b / (1 << 16) < 2 for b in files)


def test_shards_of_nothing_and_second_writer(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    store = ShardStore(spark, str(tmp_path / "store"))
    assert load_in_arrivals(store, empty, "doc_id", arrivals=3).count() == 0
    with pytest.raises(Exception, match="exist"):
        store._commit(store.manifest(), store.versions()[-1])


def test_op7_digests(spark):
    got = queries.op7_sharding(spark, SF)
    wanted = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"))
    got = got.select(wanted.columns)
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0
