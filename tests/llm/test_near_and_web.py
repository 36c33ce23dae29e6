"""Jaccard join, revisits, main text, licenses and the pipeline."""

import random
import re
import textwrap
from collections import Counter
from datetime import datetime, timedelta, timezone

import corpus_pipeline
from conftest import SF_DIR

from docledger.llm import components, html, jaccard, licenses, warc
from docledger.llm.common import Scratch

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = SPACES.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return Counter((name, len(s), least.get(root(i))) for i, ((name, _), s) in enumerate(zip(rows, sets)))


def near_corpus(seed=9):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Alpha", "beta", "é", "d4", "E"]) + str(rnd.randint(0, 40))
    text = lambda n: [word() for _ in range(n)]
    passage, rows = text(25), []
    for _ in range(12):
        base = text(rnd.choice([4, 7, 40, 90, 200]))
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 7])):
                own[rnd.randrange(len(own))] = word()
            rows.append(" ".join(own) if rnd.random() < 0.5 else "  ".join(own).upper())
    rows += [" ".join([*passage, *text(rnd.choice([5, 8, 30]))]) for _ in range(40)]
    rows += [" ".join(passage)] * 6
    chain = text(60)  # neighbours link, the ends do not
    for i in range(0, 30, 3):
        chain[i] = word()
        rows.append(" ".join(chain))
    rows += [None, "", " \n", "one", "One", "one two three four", "long " * 20_000, " ".join(text(5000))]
    rnd.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)] + [(None, "one"), (None, "alone here"), (3, rows[3]), (3, rows[3])]


def test_jaccard(spark):
    rows = near_corpus()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, component_id int").repartition(6)
    got = jaccard.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == plain_components(rows)


def test_jaccard_leaves_alone_are_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "TILE", 3)
    rows = near_corpus(10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.jaccard_components(docs).collect())) == plain_components(rows)


def test_jaccard_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0
    wordless = spark.createDataFrame([(2, None), (1, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(wordless).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_bitmaps_never_exceed_the_difference():
    rnd = random.Random(11)
    for _ in range(200):
        a = jaccard.shingles(" ".join(str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 900))).encode())
        b = jaccard.shingles(" ".join(str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 900))).encode())
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert jaccard.least_difference(jaccard.parity(a), jaccard.parity(b)) <= apart


def test_components(spark):
    rnd = random.Random(12)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(None, 1)]
    table = spark.createDataFrame(edges, "u long, v long")
    got = dict(map(tuple, components.components(table, Scratch(spark, "test")).collect()))
    label = {n: n for e in edges if None not in e for n in e}
    for _ in range(60):
        for u, v in edges:
            if u is not None:
                label[u] = label[v] = min(label[u], label[v])
    assert got == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}


RECORDS = "record_id long, url string, time timestamp, kind string, headers map<string,string>, digest string, outcome int"
DAY = datetime(2024, 3, 1, tzinfo=timezone.utc)


def at(hours):
    return DAY + timedelta(hours=hours)


def test_revisits(spark):
    rows = [
        (1, "http://A.example/x/", at(0), "response", {"ETag": 'W/"1"', "Date": "d0", "Content-Type": "text"}, "h1", 0),
        (2, "https://www.a.example/x#f", at(30), "RESPONSE", {"ETag": '"2"', "Content-Type": "html"}, "h2", 0),
        (3, "http://a.example:80/x?utm_source=q", at(2), "revisit", {"etag": '"1"', "DATE": "d3", "content-type": "no", "Age": "4"}, None, 0),
        (4, "http://a.example/x", at(60), "revisit", {"etag": '"1"'}, None, 0),
        (5, "http://a.example/x", at(61), "revisit", None, "h2", 0),
        (6, "http://a.example/x", at(62), "revisit", {}, None, 0),
        (7, "http://a.example/x", at(0), "revisit", {"etag": '"1"'}, None, 0),
        (8, None, at(5), "revisit", {"etag": '"1"'}, None, 0),
        (9, "http://a.example/x", None, "revisit", {"etag": '"1"'}, None, 0),
        (10, "http://a.example/x?b=2&a=1", at(1), "response", {"Last-Modified": "m"}, None, 0),
        (11, "http://a.example/x?a=1&ref=z&b=2", at(900), "revisit", {"last-modified": "m"}, None, 0),
        (11, "http://a.example/x?a=1&ref=z&b=2", at(900), "revisit", {"last-modified": "m"}, None, 0),
        (12, "http://a.example/x", at(1), "request", {}, None, 0),
        (None, "http://a.example/x", at(63), "revisit", {"etag": '"2"'}, "other", 0),
    ]
    found = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    got = Counter((r.record_id, r.outcome, r.refers_to) for r in found)
    assert got == Counter(
        [(3, "resolved", 1), (4, "mismatch", None), (5, "resolved", 2), (6, "unverified", None), (7, "no_response", None)]
        + [(8, "no_response", None), (9, "no_response", None), (11, "resolved", 10), (11, "resolved", 10), (None, "mismatch", None)]
    )
    merged = next(r.headers for r in found if r.record_id == 3)
    assert merged == {"etag": '"1"', "date": "d3", "content-type": "text", "age": "4"}
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisits_of_a_hot_url(spark):
    rnd = random.Random(13)
    rows = []
    for i in range(400):
        kind = rnd.choice(["response", "revisit"])
        rows.append((i, rnd.choice(["http://h.example/"] * 9 + ["http://i.example/"]), at(rnd.randint(0, 300)), kind, {"ETag": str(rnd.randint(0, 2))}, None, 0))
    wanted = {}
    for i, url, time, kind, headers, *_ in rows:
        if kind == "revisit":
            base = max(((r[2], r[0], r[4]["ETag"]) for r in rows if r[3] == "response" and r[1] == url and r[2] < time), default=None)
            wanted[i] = "no_response" if base is None else "resolved" if base[2] == headers["ETag"] else "mismatch"
    found = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS), span_seconds=36_000)
    assert {r.record_id: r.outcome for r in found.collect()} == wanted


LAYOUT = (
    "<html><head><title>no</title><script>var a='<p>no</p>';</script></head><body><header>Site</header><nav><a href=/>Menu</a></nav>"
    "<div class='cookie-notice'>We use cookies</div><div id=main><div class='post-{n}'><h1>Head {n}</h1><p>First&nbsp;&amp; <b>bold</b>\n"
    " text of page {n}<br>goes on.<p>Second paragraph &lt;here&gt;.<!-- <p>no --><div class=ad>Buy</div><form><p>Sign</p></form>"
    "<aside>Aside</aside><ul><li>one<li>two</ul></div><div id=comments><p>{c}</p></div></div><footer>&copy; us</footer></body></html>"
)
MAIN = "Head {n}\nFirst & bold text of page {n} goes on.\nSecond paragraph <here>.\none\ntwo"


def test_main_text(spark):
    rows = [(i, f"https://H.example/{i}", LAYOUT.format(n=i, c="me too " * (i * 3)), 1) for i in range(20)]
    rows += [(100, None, None, 1), (101, "x", "", 1), (102, "http://e.example/", "only words", 1), (None, None, "<p>a<p>b", 1)]
    rows += [(103, "http://e.example/", "<article>" + "<p>word &amp; </p>" * 20_000 + "</article>", 1), rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html.main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == MAIN.format(n=i) for i in range(20))
    assert (text[100], text[101], text[102], text[None]) == ("", "", "only words", "a\nb")
    assert text[103] == "\n".join(["word &"] * 20_000) and all(r.n_chars == len(r.text) for r in got)
    assert html.main_text(pages.limit(0)).count() == 0


def test_consensus_beats_the_page():
    page = "<body><div class=t><p>short</p></div><div class=other><p>{}</p></div></body>".format("long " * 50)
    assert html.extract(page, ["body/div.t"]) == "short"
    assert html.extract(page, ["body/div.none"]).startswith("long")


def test_the_whole_article_is_kept(spark):
    nav, body = "<nav><a href=/>Menu</a></nav><div class=list><a href=/x>Other page</a></div>", "<p>" + "word " * 60 + "</p>"
    pages = [
        f"<body>{nav}<article><h1>T</h1><div>{body}</div></article>",
        f"<body>{nav}<article><header><h1>T</h1></header><div><div><div>{body}</div></div></div></article>",
        f"<body>{nav}<div class=wrap><h1>T</h1><div class=text>{body}</div></div>",
        f"<body>{nav}<h1>T</h1><div class=text>{body}</div>",
        f"<body>{nav}<main><section class=a><p>T</p></section><section class=b>{body}</section></main>",
    ]
    rows = [(i, f"https://h{i}.example/{k}", page) for i, page in enumerate(pages) for k in range(3)]
    got = html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    words = ("word " * 60).strip()
    assert {r.page_id: r.text for r in got if r.page_id != 3} == {i: f"T\n{words}" for i in (0, 1, 2, 4)}
    assert all(r.text.endswith(f"T\n{words}") for r in got)


def test_a_box_on_a_winning_path_is_not_the_page(spark):
    box, long = "<div class=t><p>{}</p></div>", "long " * 50
    other = f"<body>{box.format('short')}<div class=other><p>{long}</p></div>"
    assert html.extract(other, ["body/div.t", "body/div.other"]) == long.strip()
    assert html.extract(other.replace("div class=other", "article"), ["body/div.t"]) == long.strip()
    rows = [(i, "http://h.example/", "<body>" + box.format(f"text {i} " * 20)) for i in range(60)]
    rows += [(i, "http://h.example/", other) for i in (60, 61)]
    rows += [(62, "http://h.example/", other.replace("other", "once"))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert len(got) == 63 and all(got[i] == (f"text {i} " * 20).strip() for i in range(60))
    assert got[60] == got[61] == long.strip() and got[62] == "short"


def test_a_part_of_a_name_does_not_drop_the_article():
    page = "<body><div {}><p>{}</p><div class=related-posts>More</div></div><div class=post-related-works>Box</div><p>End.</body>"
    for name in ("class='content has-sidebar'", "class=no-ads", "class=with-footer", "id=social-science", "class=post-related-works"):
        text = html.extract(page.format(name, "word " * 50), [])
        assert text.startswith("word word") and "More" not in text and "Box" not in text, name
    for name in ("class=comments-area", "id=sidebar"):
        assert html.extract(page.format(name, "word " * 50), []) == "End."


def test_licenses(spark):
    text = "Intro.\nReleased under the MIT License.\nMore.\nLicensed under CC BY-NC 4.0.\nx\nLicensed under the Apache License, Version 1.1.\nend"
    rows = [(1, text, 0), (2, None, 0), (3, "", 0), (4, "no notice", 0), (5, "a " * 50_000 + "\nAll rights reserved.", 0), (1, text, 0)]
    rows += [(6, "My driving licence expired, and I was denied permission to drive.", 0), (7, "long " * 300 + "Released under the MIT License. " + "on " * 300, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses int")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: [(f.license, f.start) for f in r.licenses if f.confirmed] for r in got}
    assert named[1] == [("MIT", 7), ("CC-BY-NC-4.0", text.index("Licensed under CC"))]
    assert named[5] == [("Proprietary", 100_001)] and not named[2] + named[3] + named[4] + named[6]
    old = [f for f in got[0].licenses if f.block.endswith("1.1.")]
    assert old[0].license == "Apache-2.0" and old[0].lacking == ["2.0"] and old[0].added == ["1.1"]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_template_is_its_own_winner():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            best = scanner.judge(text)
            assert best["confirmed"] and not best["lacking"], text
            assert best["license"] == name, text
            assert licenses.ROOTS.search(text), text


def notices(text):
    return [f["license"] for f in licenses.Scanner(licenses.TEMPLATES).findings(text) if f["confirmed"]]


def test_notices_cross_line_ends_and_cuts():
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            wrapped = textwrap.indent(textwrap.fill(text, 40), " * ")
            assert notices(f"Intro.\n{wrapped}\nend") == [name], wrapped
            for before in (250, 330, 390):
                assert notices("x " * before + text + " on" * 300) == [name], (before, text)
    lesser = "\n".join(licenses.TEMPLATES["GPL-3.0"]).replace("GNU General", "GNU Lesser General")
    assert notices(lesser) == ["LGPL-3.0"]


def test_each_notice_has_a_finding():
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Licensed under the MIT License."
    assert notices(f"{mit}\n{apache}") == notices(f"{mit} {apache}") == ["MIT", "Apache-2.0"]
    assert notices("Licensed under the MIT License or the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert notices(f"All rights reserved.\n{mit}\n{mit}") == ["Proprietary", "MIT", "MIT"]
    known = [(name, text) for name, texts in licenses.TEMPLATES.items() for text in texts]
    for (one, a), (two, b) in zip(known, known[1:] + known[:1]):
        assert notices(f"{a}\n{b}") == [one, two]
        assert notices("x " * 300 + f"{b} {a}" + " on" * 300) == [two, one]
    both = licenses.Scanner(licenses.TEMPLATES).findings(f"{mit}\n{apache.replace('2.0', '1.1')}")
    assert [(f["license"], f["confirmed"], f["start"]) for f in both] == [("MIT", True, 0), ("Apache-2.0", False, len(mit) + 1)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept, before = docs, {r.doc_id: r.text for r in docs.collect()}
    scratch, names = Scratch(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, kept, SF_DIR)
        assert sorted(step.columns) == sorted(docs.columns), name
        kept = scratch.keep(step, name)
        names.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert all(b <= a for a, b in zip([set(before), *names], names)) and all(len(a) for a in names)
    quality, unique = names[0], names[1]
    groups = plain_components([(i, before[i]) for i in sorted(quality)])
    assert unique == {c for _, n, c in groups if n}
    rows = kept.collect()
    counts = Counter(r.doc_id for r in rows)
    assert max(counts.values()) <= 2
    assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
    final = corpus_pipeline.STAGES[-1][1](spark, kept, SF_DIR).collect()
    assert Counter(r.doc_id for r in final) == counts
    assert min(r.start for r in final) == 0 and max(r.start + r.n_tokens for r in final) == sum(r.n_tokens for r in final)


def test_pipeline_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "The cat is on the mat, and it was fine.", None, "s", 40), (4, "The cat is on the mat, and it was fine.", None, None, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF_DIR)
        assert now.count() == (2 if table is docs else 0) or table is docs


def test_headers_that_differ_in_case_only(spark):
    rows = [
        (1, "http://a.example/x", at(0), "response", {"etag": '"2"', "ETag": '"1"', "Date": "d", "date": "e"}, None, 0),
        (2, "http://a.example/x", at(1), "revisit", {"eTag": '"9"', "ETAG": '"1"'}, None, 0),
    ]
    (row,) = warc.resolve_revisits(spark.createDataFrame(rows, RECORDS)).collect()
    assert (row.outcome, row.headers) == ("resolved", {"etag": '"1"', "date": "d"})
