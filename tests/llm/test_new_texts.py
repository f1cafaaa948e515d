"""Importance resampling, spelling variants and page texts against plain versions, and their awkward rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidepool.llm import importance, page_text, spelling
from tidepool.llm.entry import OP11_SQL, OP12_SQL, op11_importance, op12_spelling, op13_page_text

from .helpers import awkward_texts, docs_frame, with_doubles


@pytest.mark.parametrize("query, sql", [(op11_importance, OP11_SQL), (op12_spelling, OP12_SQL)])
def test_query_is_its_sql(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.execute(sql), query(spark, sf_dir)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def plain_importance(rows, target, n=1, buckets=10_000, least=20, percent=10, seed="2024"):
    """(doc_id, n_words, n_features, weight, score) of each (doc_id, text), and how many are drawn."""

    def cells(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(cells(text)[1])
    for text in target:
        t.update(cells(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in rows:
        words, found = cells(text)
        weight = math.floor(sum(map(gain, found)) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out, sum(r[1] >= least for r in out) * percent // 100


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (2, 70_000, 50), (3, 50, 100)])
def test_importance_of_awkward_rows(spark, n, buckets, percent):
    docs = with_doubles(docs_frame(spark)).withColumnsRenamed({"n": "rank", "fp": "weight", "node": "key", "ids": "score", "size": "row"})
    target = spark.createDataFrame([(None, 1), ("", 2), ("River stone river 3 LAMP", 3), ("paper über", 4)], "text string, rank int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, drawn = plain_importance(rows, [r.text for r in target.collect()], n, buckets, percent=percent)
    got = importance.importance(docs, target, most_words=n, buckets=buckets, percent=percent).collect()
    assert Counter((r.row.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))[:drawn]
    assert [(r.rank, r.row.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank or 1 << 60) if r.rank] == [(k, r[0], r[4]) for k, r in enumerate(able, 1)]
    kept = importance.resample(docs, target, most_words=n, buckets=buckets, percent=percent)
    assert kept.columns == docs.columns and Counter(r.text for r in kept.collect() if r.doc_id is not None) == Counter(dict(rows)[r[0]] for r in able if r[0] is not None)


def test_importance_of_empty_tables(spark):
    docs = docs_frame(spark)
    assert importance.importance(docs.limit(0), docs).count() == 0
    some = docs.filter("doc_id in (6, 7)")
    want, _ = plain_importance([(r.doc_id, r.text) for r in some.collect()], [])
    assert sorted(tuple(r.row) + (r.n_words, r.n_features, r.weight, r.score) for r in importance.importance(some, docs.limit(0)).collect()) == sorted(want)


def plain_variants(rows, least=3, modulus=97):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: f[0] if f and words[f[0]] >= 2 * words[w] else None for w, f in found.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(found[w]), words[form[w]] if form[w] else None) for w in words}


def variant_rows(docs, **options):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, **options).collect()}


def test_spelling_variants_of_few_letters(spark):
    r = random.Random(5)
    some = ["".join(r.choice("abé") for _ in range(r.choice([4, 5, 5, 6, 6, 7, 8, 9, 11, 12, 13, 17]))) for _ in range(150)]
    for w in some[:120]:  # one and two edits away, in every place
        at, c = r.randrange(len(w)), r.choice("abé")
        some += [w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:] + c]
    texts = [" ".join(r.choice([w, w.upper() if w.isascii() else w]) for w in r.choices(some, [1 / (1 + k % 37) for k in range(len(some))], k=400)) for _ in range(30)]
    docs = docs_frame(spark, texts + ["", None, "1 2 3", "Ãéîõü" * 3 + " ãÉîõü ÃéîõüÃéîõüÃéîõü"])
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    want = plain_variants(rows)
    assert variant_rows(docs) == want and len(want) > 300 and sum(w[4] > 0 for w in want) > 200 and any(w[2] != (w[1] or w[0]) for w in want)
    assert variant_rows(docs, least=1, modulus=2) == plain_variants(rows, 1, 2)


def test_spelling_in_cut_routes_and_large_groups(spark):
    r = random.Random(6)
    words = {"commonlyab" + "".join(r.choice("abcd") for _ in range(4)) for _ in range(200)} | {"".join(r.choice("ab") for _ in range(3)) + "ending" for _ in range(8)}
    frame = spark.createDataFrame([(w, 3 + k % 50) for k, w in enumerate(sorted(words))], "word string, n long")
    want = {w: {v for v in words if spelling.one_edit(v, w)} for w in words}
    for shard in (8192, 16):
        got = {x.word: x for x in spelling.near_words(frame, shard).collect()}
        assert {w: x.n_near for w, x in got.items()} == {w: len(v) for w, v in want.items() if v}
    halves = spelling.Halves(0, dict.fromkeys(words, 3))
    assert max(map(len, halves.by.values())) > 64


def test_spelling_of_awkward_rows(spark):
    docs = with_doubles(docs_frame(spark)).withColumnsRenamed({"n": "word", "fp": "form", "node": "root"})
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    want = plain_variants(rows)
    assert variant_rows(docs) == want and want
    assert variant_rows(docs.limit(0)) == set()


def article_text(page):
    body = re.search("(?s)<article>(.*?)</article>", page)[1]
    lines = re.split("</?(?:p|h1)>", body)
    return "\n\n".join(t for x in lines if (t := " ".join(html.unescape(re.sub("<[^>]*>", lambda g: " " if g[0] == "<br>" else "", x)).split())))


def test_pages_of_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op13_page_text(spark, sf_dir).collect()
    assert len(got) == len(pages) and all(r.text == article_text(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in got)
    assert all(r.n_set_aside + r.n_shared >= 3 for r in got)


def bare_page(site, number, words):
    """A page whose markup says nothing: only other pages of the site tell its furniture."""
    menu = "".join(f"<div class=q{k}>{site} item {k}</div>" for k in range(5))
    paragraphs = "".join(f"<div class=b>{w}\n &amp; <i>so</i> on</div>" for w in words)
    return f"<html><title>t{number}</title><body>{menu}<div>Accept our terms of {site}</div><section>{paragraphs}</section><div>More from {site}</div><div>Mail to {site}"


def test_pages_are_differenced_with_the_nearest(spark):
    rows, want = [], {}
    for s, site in enumerate(["one.example", "Two.example", "lonely.example"]):
        for n in range(1 if s == 2 else 14):
            words = [f"paragraph {k} of page {n} at {site.lower()}" for k in range(2 + n % 3)]
            words += ["a passage that all quote"] * (n in (3, 11))  # shared with one page, but not with the nearest
            rows.append((s * 100 + n, f"https://{site if n % 2 else site.lower()}/{'en' if n < 7 else 'fr'}/{n:03}?x={n}", bare_page(site.lower(), n, words)))
            want[s * 100 + n] = "\n\n".join(f"{w} & so on" for w in words)
    rows += [(900 + k, u, h) for k, (_, u, h) in enumerate(rows[3:6] * 20)]  # copies aren't each other's neighbours
    got = {r.page_id: r for r in page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == t for i, t in want.items() if i != 200)
    assert got[200].text.startswith("lonely.example item 0") and got[200].n_shared == 0
    assert got[3].n_shared == 8 and all(got[900 + k].text == got[(3, 4, 5)[k % 3]].text for k in range(60))


def test_named_furniture_goes_and_the_article_stays(spark):
    page = """<!doctype html><html class=no-menu><head><title>T</title><style>a{}</style><body class="page has-sidebar">
    <div id="cookie-notice">We use <b>cookies</b></div><header><h1>Site</h1><form><input><label>Find</label></form></header><nav><ul><li>a<li>b</ul></nav>
    <div class="layout sidebar-left"><aside>Aside <article>teaser</article></aside><article class=post><header><h1>Head&shy;line &amp; more</h1></header>
    <p>First&nbsp;line<br>goes <em>o</em>n<p>Second a < b &lt;i&gt; <script>var x = "</article><p>no";</script><!-- <p>no --><ul><li>one<li>two</ul>
    <div class="ad-slot">Buy</div><table><tr><td>c1<td>c2<tr><td>c3</table><pre>x\n  y</pre><section class="comments"><article class=comment><p>I agree</article></section>
    <article>another reader</article><p>Last</article><section id=comments><article>Me too</article></section></div><footer>F</footer><script>if (1 < 2) "</p>"</script>"""
    texts, zones = page_text.blocks(page)
    assert [t for t, z in zip(texts, zones) if z == page_text.INSIDE] == ["Head\xadline & more", "First line goes on", "Second a < b <i>", "one", "two", "c1", "c2", "c3", "x y", "Last"]
    assert page_text.OUTSIDE not in zones and {"Aside", "teaser", "Me too", "F"} <= set(texts)


def test_awkward_pages(spark):
    pages = [(1, "http://a.example/x", None), (2, "http://a.example/x", ""), (3, None, "<article><p>kept</article>"), (4, "no host", "plain <b>text</b>"), (None, "http://b.example/y", "<p>" + "long words " * 200_000), (5, "http://b.example/z", "<div>" * 2000 + "deep"), (3, None, "<article><p>kept</article>")]
    frame = spark.createDataFrame([(*p, "h", "s", "b") for p in pages], "page_id long, url string, html string, host string, shape string, blocks string")
    got = Counter((r.page_id, r.text[:20], r.n_chars) for r in page_text.main_texts(frame).collect())
    assert got == Counter([(1, "", 0), (2, "", 0), (3, "kept", 4), (3, "kept", 4), (4, "plain text", 10), (None, "long words long word", 2_199_999), (5, "deep", 4)])
    assert page_text.main_texts(frame.limit(0)).count() == 0


def test_alignment_is_a_longest_common_subsequence():
    r = random.Random(7)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = page_text.common(a, b)
        rest = iter(b)
        assert len(got) == best[-1][-1] and got == sorted(set(got)) and all(a[i] in rest for i in got)
