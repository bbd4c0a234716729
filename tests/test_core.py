"""Core operators against hand-made values, and every query against SQL on the smallest tables."""

import io
import random
import re
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import index, near_duplicates, search
from lodestone.operators.components import components
from lodestone.plans import report
from lodestone.sources import extract, files, pdf

DATA = "/root/testdata/sf0.001"
NOW = 1_760_000_000
YEAR = int(365.25 * 86400)
DOC = "kb_id string, doc_id string, rel string, path string, name string, folder string, ext string, size long, mtime long, status string, reason string, author string, chash string, nwords int, ntok int, text string"


def doc(rel, text="", status="ok", kb="k", mtime=NOW, size=1000, author=None, reason=None, chash=None, ntok=None):
    name, folder = rel.rsplit("/", 1)[-1], rel.rsplit("/", 1)[0] if "/" in rel else ""
    ext = "." + name.rsplit(".", 1)[1] if "." in name else ""
    return (kb, rel, rel, rel, name, folder, ext, size, mtime, status, reason, author, chash, len(text.split()), ntok, text)


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("word", "stem"), [("prices", "price"), ("running", "run"), ("billing", "bill"), ("classes", "class"), ("parties", "party"), ("dies", "die"), ("bus", "bus"), ("planned", "plan"), ("red", "red"), ("gas", "gas"), ("sing", "sing"), ("needed", "need")])
def test_stem(spark, word, stem):
    assert search.stem(word) == stem
    assert spark.createDataFrame([(word,)], "w string").select(T.stem(F.col("w"))).first()[0] == stem


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße ΣΟΦΟΣ don't v1.2 x_y", "A  b\r\n\r\n\r\n\r\nc "), (None, None), ("", "")], "a string, b string")
    got = df.select(T.words(F.col("a")).alias("w"), T.tidy(F.col("b")).alias("t"), T.word_count(F.col("a")).alias("n")).collect()
    assert got[0].w == ["strasse", "σοφοσ", "don't", "v1.2", "x", "y"]
    assert got[0].t == "A b\n\nc" and got[1].t is None and got[2].w == []
    assert [x.n for x in got] == [5, 0, 0]
    page = "<head><title>x</title></head><p>One &amp; two</p><!-- no --><script>var a</script><br/>three"
    assert spark.createDataFrame([(page,)], "h string").select(T.strip_markup(F.col("h"))).first()[0].split() == ["One", "&", "two", "three"]
    same = [("Price,  LIST 5",), ("price list\n5",)]
    assert spark.createDataFrame(same, "t string").select(T.content_hash(F.col("t"))).distinct().count() == 1


def test_parse():
    q = search.parse('price "work order" -draft -"stock cards" ext:PDF folder:"Jobs" the')
    assert (q.terms, q.phrases, q.not_terms, q.not_phrases, q.exts, q.folders) == (["price", "work", "order"], ["work order"], ["draft", "stock", "card"], ["stock cards"], [".pdf"], ["jobs"])
    assert search.parse("").why_empty() == "" and search.parse("the of").why_empty().startswith("only very common words")
    assert search.parse("-x").why_empty().startswith("only exclusions") and search.parse('"" ()').why_empty().startswith("nothing")
    for bad in ['"', "((", "[a", "-", '-"', "ext:", "folder:", "\\", "*", "a(b", "C++", None, " \t"]:
        search.parse(bad)


def test_bm25_by_hand(spark):
    docs = frame(spark, [doc(d, ntok=n) for d, n in (("d1", 10), ("d2", 100), ("d3", 40))])
    posted = spark.createDataFrame([("k", "roof", "d1", 3), ("k", "roof", "d2", 6)], "kb_id string, term string, doc_id string, tf int")
    got = {x.doc_id: round(x.score, 4) for x in search.bm25(posted, docs, ["roof"]).collect()}
    assert got["d1"] > got["d2"] and got.keys() == {"d1", "d2"}
    assert got == {"d1": 0.9792, "d2": 0.8174}


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {
        "lists/price-list.txt": "Price list. The price of pipe is 5.", "manual/safety.pdf": "Wear protective equipment and check prices " + "always " * 60,
        "contracts/vendor.docx": "Vendor agreement draft for pipe supply", "scans/scan.pdf": "",
    }
    docs = frame(spark, [doc(r, t, "ok" if t else "unreadable", mtime=NOW - i) for i, (r, t) in enumerate(texts.items())]).cache()
    posted = index.postings(docs).cache()
    return posted, docs.drop("ntok").join(index.lengths(posted), index.KEY, "left").select(*docs.columns)


@pytest.mark.parametrize(("text", "expected"), [
    ("price", ["lists/price-list.txt", "manual/safety.pdf"]), ('"protective equipment"', ["manual/safety.pdf"]), ('"equipment protective"', []), ("agreement -draft", []),
    ("agreement", ["contracts/vendor.docx"]), ("ext:pdf", ["manual/safety.pdf", "scans/scan.pdf"]), ("folder:contracts", ["contracts/vendor.docx"]), ("", []), ("the", []), ('pipe -"vendor agreement"', ["lists/price-list.txt"]),
])
def test_search(spark, corpus, text, expected):
    got = search.search(*corpus, text).orderBy("rank").collect()
    assert [x.rel for x in got] == expected and all(x.total == len(expected) for x in got)


def test_snippets(spark, corpus):
    page = search.snippets(search.search(*corpus, "price"), corpus[1], search.parse("price")).collect()
    assert all("".join(p.t for p in x.parts) == x.snippet for x in page) and any(p.hit for p in page[0].parts)
    start = time.time()
    for _ in range(20):
        search.snippet("word " * 20000 + "needle here", search.mark_pattern(["needle", "x" * 10_000], []))
    assert time.time() - start < 5
    assert search.snippet("", search.mark_pattern(["a"], [])) == ("", []) and search.snippet("plain", None)[0] == "plain"
    found = search.answer(*corpus, "the", with_snippets=False)
    assert found.reason.startswith("only very common words") and found.results.count() == 0
    (top,) = search.answer(*corpus, "vendor").results.collect()
    assert top.rel == "contracts/vendor.docx" and not top.at_least and [p.t for p in top.parts if p.hit] == ["Vendor"]


def test_densest_window():
    """Against trying every start, and the parts against the text."""
    rnd = random.Random(4)
    for _ in range(200):
        text = " ".join(rnd.choice(["pipe", "roof", "or", "beam\nlong", "x" * rnd.randint(1, 60)]) for _ in range(rnd.randint(1, 120)))
        pattern = search.mark_pattern(["pi", "beam"], ["roof or"])
        spans, width = search.hit_spans(text, pattern), rnd.choice([40, 90, 260])
        got, parts = search.snippet(text, pattern, width)
        assert got == "".join(t for t, _ in parts) and len(got) <= width + 4
        if spans:
            a, b = search.densest(spans, width)
            assert b - a == max(sum(s <= x <= s + width for x, _ in spans) for s, _ in spans) and spans[b - 1][0] - spans[a][0] <= width
            assert any(h for _, h in parts) and all(re.match(r"pi|beam|roof or", t) or got.endswith((f"{t} …", t)) and any(w.startswith(t) for w in ("pipe", "beam", "roof or")) for t, h in parts if h)
        inner = got.removeprefix("… ").removesuffix(" …")
        assert inner in re.sub(r"\s", " ", text)


def test_snapshots(spark):
    old, new = frame(spark, [doc("a", "one"), doc("b", "two"), doc("c", "x", kb="other")]), frame(spark, [doc("b", "three"), doc("d", "four")])
    assert {(x.rel, x.text) for x in index.upsert(old, new).collect()} == {("a", "one"), ("b", "three"), ("c", "x"), ("d", "four")}
    seen = spark.createDataFrame([("k", "a")], "kb_id string, rel string")
    assert {x.rel for x in index.keep_only(old, seen).collect()} == {"a", "c"}
    assert index.keep_only(old, seen, complete=False).count() == 3
    assert {x.rel for x in index.drop_kb(old, "k").collect()} == {"c"}
    listed = spark.createDataFrame([("k", "a", 1000, NOW), ("k", "b", 999, NOW), ("k", "z", 1, 1)], "kb_id string, rel string, size long, mtime long")
    assert {x.rel for x in index.changed(old, listed).collect()} == {"b", "z"}


LOREM = "the quick supplier sends twenty five boxes of pipe to the yard and the clerk signs for every one of them before noon on a monday always"


def test_duplicates(spark):
    docs = frame(spark, [doc("a", LOREM, chash="h", mtime=NOW), doc("b", LOREM, chash="h", mtime=NOW - 2 * YEAR), doc("c", LOREM, chash="h"), doc("d", "other words here and there", chash="i"), doc("e", "ab", chash="j"), doc("f", "ab", chash="j")])
    (g,) = report.exact_groups(docs).collect()
    assert (g.files, g.newest, g.spread_years) == (3, "a", 2.0)
    (t,) = report.duplicate_totals(docs).collect()
    assert (t.files_involved, t.wasted_copies, t.share, t.exact_groups, t.near_groups) == (3, 2, 50.0, 1, 0)
    longer = f"{LOREM} and then they all go home again"
    docs = docs.unionByName(frame(spark, [doc("g", longer, chash="x", mtime=NOW - YEAR), doc("h", f"{longer} {longer}", chash="y"), doc("i", longer.replace("monday", "friday"), chash="z"), doc("j", longer, chash="v", kb="other")]))
    near = report.near_members(docs)
    (t,) = report.duplicate_totals(docs.where("kb_id = 'k'"), near).collect()
    assert (t.files_involved, t.wasted_copies, t.exact_groups, t.near_groups) == (6, 4, 1, 1)
    got = report.largest_groups(docs, near).orderBy("kind").collect()
    assert [(x.kind, x.rank, x.members) for x in got] == [("exact", 1, ["a", "c", "b"]), ("near", 1, ["h", "i", "g"])]
    (s,) = report.score(docs.where("kb_id = 'k'"), spark.createDataFrame([], "item_key string, phrases array<string>, is_on boolean"), NOW, near).collect()
    assert s.unique == 33.3 and s.covered is None and s.out_of == 75.0 and s.band in ("good", "fair", "poor", "bad")


def test_near_duplicates(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(40, 80))] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:8]:
        edited = list(b)
        edited[rnd.randrange(len(b))] = "changed"
        texts.append(" ".join(edited))
    docs = frame(spark, [doc(f"d{i:02}", t, kb=f"k{i % 2}") for i, t in enumerate(texts)] + [doc("empty", ""), doc("null", LOREM)])
    runs = {f"d{i:02}": (f"k{i % 2}", {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}) for i, t in enumerate(texts)}
    want = {(a, b) for a in runs for b in runs if a < b and runs[a][0] == runs[b][0] and len(runs[a][1] & runs[b][1]) / len(runs[a][1] | runs[b][1]) >= 0.55}
    assert {(x.a, x.b) for x in near_duplicates.pairs(docs).collect()} == want and len(want) == 8
    assert near_duplicates.groups(docs).count() == 16
    assert {(x.a, x.b) for x in near_duplicates.candidate_pairs_lsh(docs).collect()} >= want
    assert near_duplicates.pairs(docs.limit(0)).count() == 0


def test_near_duplicates_of_one_hash(spark):
    rnd = random.Random(5)
    text = lambda: [rnd.choice("αβγδεζηθ") + rnd.choice("ικλμνξοπ") + rnd.choice("ρστυφχψω") for _ in range(60)]
    one, two = text(), text()
    edited = lambda t, i: " ".join([*t[:i], "άλλο", *t[i + 1 :]])
    texts = {"a": text(), "b": one, "c": edited(one, 30), "d": two, "e": edited(two, 20), "f": " , ".join(two), "g": text()}
    docs = frame(spark, [doc(i, t if isinstance(t, str) else " ".join(t), chash="h") for i, t in texts.items()])
    want = {("b", "c", round(51 / 61, 4)), ("d", "e", round(51 / 61, 4)), ("d", "f", 1.0)}
    assert {(x.a, x.b, x.similarity) for x in near_duplicates.pairs(docs).collect()} == want
    assert {(x.group_id, x.doc_id) for x in near_duplicates.groups(docs).collect()} == {("b", "b"), ("b", "c"), ("d", "d"), ("d", "e"), ("d", "f")}
    assert {(x.a, x.b) for x in near_duplicates.candidate_pairs_lsh(docs).collect()} == {(a, b) for a, b, _ in want}


def test_lsh_recall(spark):
    rnd = random.Random(8)
    data = []
    for i in range(120):  # similarities of 73 / 127
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(104)]
        other = [*words[:54], *(f"v{rnd.randint(0, 10**6)}" for _ in range(23)), *words[77:]]
        data += [doc(f"a{i:03}", " ".join(words)), doc(f"b{i:03}", " ".join(other))]
    docs = frame(spark, data)
    want = {(x.a, x.b) for x in near_duplicates.pairs(docs).collect()}
    got = {(x.a, x.b) for x in near_duplicates.candidate_pairs_lsh(docs).collect()}
    assert len(want) == 120 and got <= want and len(got) >= 0.9 * 120


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_report(spark):
    ages = [30 * 86400, 2 * YEAR, 4 * YEAR, 7 * YEAR]
    docs = frame(spark, [doc(f"Invoices/x{i}.txt", LOREM, mtime=NOW - a) for i, a in enumerate(ages)])
    (s,) = report.staleness(docs, NOW).collect()
    assert (s.under1, s.from1to3, s.from3to5, s.over5, s.unknown, s.share_over3) == (1, 1, 1, 1, 0, 50.0)
    assert report.oldest(docs, NOW).orderBy("rank").first().years == 7.0
    mixed = frame(spark, [doc("Scans/a.pdf", status="unreadable", reason="scan"), doc("Scans/b.pdf", status="unreadable", reason="scan", size=2000), doc("Locked/c.pdf", status="unreadable", reason="", size=500), doc("p.jpg", status="skipped"), doc("t.txt", LOREM)])
    assert rows(report.unread(mixed, "folder").select("key", "files", "share", "bytes")) == [("Locked", 1, 33.3, 500), ("Scans", 2, 66.7, 3000)]
    assert {x.key for x in report.unread(mixed, "reason").collect()} == {"scan", "no reason recorded"}
    many = frame(spark, [doc(f"Invoices/{i}.txt", LOREM, author="Ann" if i < 3 else "admin") for i in range(8)] + [doc(f"x{i}.md", LOREM) for i in range(2)])
    assert rows(report.concentration(many, "folder").select("key", "share")) == [("(top level)", 20.0), ("Invoices", 80.0)]
    assert rows(report.concentration(many, "author").select("key", "files")) == [("Ann", 3)]
    assert report.counts(docs.limit(0)).count() == 0


def test_references(spark):
    docs = frame(spark, [doc("a/roof-manual.txt", "see nothing"), doc("b/notes.txt", "the roof manual says"), doc("c/2024.pdf", "roof"), doc("d/orphan.txt", "orphan orphan")])
    got = {x.rel: x.verdict for x in report.references(docs).collect()}
    assert got == {"a/roof-manual.txt": "referenced", "b/notes.txt": "unreferenced", "c/2024.pdf": "unjudged", "d/orphan.txt": "unreferenced"}


def test_coverage_and_score(spark):
    items = spark.createDataFrame([("safety", ["safety", "ppe"], True), ("backup", ["backup"], None), ("off", ["manual"], False)], "item_key string, phrases array<string>, is_on boolean")
    docs = frame(spark, [doc("Safety Manual.txt", "shipped goods"), doc("memo.txt", "our Back-up and BACKUP rules"), doc("x.pdf", status="unreadable")])
    got = {x.item_key: (x.named, x.found, x.in_name, x.in_text) for x in report.coverage(docs, items).collect()}
    assert got == {"safety": (True, True, 1, 0), "backup": (False, True, 0, 1)}
    finds = report.coverage_of_files(docs.unionByName(docs), items)
    assert rows(report.coverage_hits(finds).select("item_key", "rank", "place", "phrase")) == [("backup", 1, "text", "backup"), ("safety", 1, "name", "safety")]
    (c,) = report.coverage_summary(docs, items, report.coverage(docs, items)).collect()
    assert (c.checked, c.found, c.named, c.mentioned, c.credit, c.credit_share, c.missing, c.mentioned_only) == (2, 2, 1, 1, 1.5, 75.0, [], ["backup"])
    (s,) = report.score(docs, items, NOW).collect()
    assert (s.readable, s.current, s.unique, s.covered, s.spread, s.out_of) == (66.7, 100.0, 100.0, 75.0, 0.0, 100.0)
    (none,) = report.score(frame(spark, [doc("x.pdf", status="unreadable")]), items, NOW).collect()
    assert (none.readable, none.current, none.out_of) == (0.0, None, 25.0)


def test_weights():
    for given in ({"readable": 1, "current": 1, "unique": 1, "covered": 1, "spread": 2}, {"readable": 0, "spread": 7}, {"unique": float("nan")}, {"readable": "x", "covered": -3}):
        assert round(sum(report.scaled_weights(given).values()), 6) == 100
    assert report.scaled_weights(None) == report.WEIGHTS == report.scaled_weights(dict.fromkeys(report.WEIGHTS, 0))


def test_shares():
    rnd = random.Random(9)
    for _ in range(200):
        parts = [rnd.random() * rnd.choice([0, 1, 100]) for _ in range(5)]
        if any(parts):
            got = report.shared_out(parts, 1000)
            assert sum(got) == 1000 and all(abs(n - 1000 * x / sum(parts)) < 1 for n, x in zip(got, parts))


def test_whole_report(spark):
    """All sections at once, as JSON and Markdown; a stopped scan is said first."""
    import json

    items = spark.createDataFrame([("safety", "Safety rules", "w", ["safety"], True), ("audit", "AUDIT trail", "w", ["audit"], True)], "item_key string, label string, why string, phrases array<string>, is_on boolean")
    kbs = spark.createDataFrame([("k", None, True), ("other", 0.9, False)], "kb_id string, near_threshold double, is_partial boolean")
    docs = frame(spark, [doc("Jobs/Safety | plan.txt", LOREM, mtime=NOW - 4 * YEAR), doc("Jobs/b.txt", "short"), doc("c.pdf", status="unreadable", reason="scan"), doc("p.jpg", status="skipped"), doc("x.txt", LOREM, kb="other")])
    docs = docs.unionByName(docs.where("rel = 'Jobs/b.txt'"))  # a row written twice
    tables = report.sections(docs, kbs, items, NOW)
    got = {x.kb_id: json.loads(x.report) for x in report.assembled(tables).collect()}
    k = got["k"]
    assert k["counts"]["total"] == 4 and k["coverage"]["missing"] == ["AUDIT trail"] and [x["part"] for x in k["score_parts"]] == [*report.WEIGHTS]
    assert round(sum(x["points"] for x in k["score_parts"]), 1) == k["score"]["points"]
    said = [x["kind"] for x in k["findings"]]
    assert said[0] == "partial" and [x["severity"] for x in k["findings"][1:]] == sorted((x["severity"] for x in k["findings"][1:]), reverse=True) and "aUDIT trail" in str(k["findings"])
    assert "partial" not in str(got["other"]["findings"]) and got["other"]["counts"]["total"] == 1
    text = report.markdown("Base", json.dumps(k), "/srv/x", "today")
    assert text.startswith("# Base") and text.index("stopped early") < text.index("## Score") and "Safety \\| plan.txt" in text
    assert report.slug("My Base: 2 / ä") == "my-base-2" and report.slug("é") == "report"


def test_bands(spark):
    df = spark.createDataFrame([(80.0, 100.0), (79.9, 100.0), (30.0, 75.0), (10.0, 100.0), (0.0, 0.0)], "p double, o double")
    assert [x[0] for x in df.select(report.band(F.col("p"), F.col("o"))).collect()] == ["good", "fair", "poor", "bad", "none"]


def test_documents_written_twice(spark):
    a, b = doc("a", "one"), doc("a", "two", mtime=NOW + 1)
    df = frame(spark, [a, b, doc("b", "x"), doc("b", "x"), doc("c", "y")])
    want = {(x.rel, x.text) for x in index.documents(df).collect()}
    assert want == {("a", "two"), ("b", "x"), ("c", "y")} == {(x.rel, x.text) for x in index.documents(df.repartition(3).orderBy(F.rand())).collect()}
    assert index.documents(df, "rel").columns == ["kb_id", "doc_id", "rel"] and index.documents(df, "kb_id").count() == 3
    assert [(x.rel, x.total) for x in index.listed(df, limit=2).orderBy("rank").collect()] == [("a", 3), ("b", 3)] and index.listed(df, "skipped").count() == 0
    (row,) = index.lookup(df, "k", "a", most=2).collect()
    assert (row.text, row.text_cut) == ("tw", True) and index.lookup(df, "k", "z").count() == 0


# --- files -----------------------------------------------------------------------------------


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, f'<?xml version="1.0"?>{body}')
    return out.getvalue()


CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>Ann Lee</dc:creator></cp:coreProperties>'


def simple_pdf(lines, packed=True, tail=b"%%EOF"):
    content = b"BT /F1 12 Tf 72 700 Td " + b" 0 -14 Td ".join(b"(" + x.encode("cp1252") + b") Tj" for x in lines) + b" ET"
    body = zlib.compress(content) if packed else content
    how = b"/Filter /FlateDecode " if packed else b""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< " + how + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream", b"<< /Type /Font /Subtype /Type1 >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>\nstartxref\n0\n" + tail


def test_extract_office():
    word = office({"word/document.xml": '<w:document xmlns:w="w"><w:p><w:r><w:t>Price</w:t><w:tab/><w:t>list</w:t></w:r></w:p><w:p><w:t>second line</w:t></w:p></w:document>', "docProps/core.xml": CORE})
    assert extract.extract(word, ".docx") == ("ok", "Price list\nsecond line", None, "Ann Lee")
    sheet = office({"xl/sharedStrings.xml": '<sst xmlns="s"><si><t>item</t></si><si><t>qty</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="s"><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>7</v></c><c t="inlineStr"><is><t>in</t></is></c></row></worksheet>'})
    assert extract.extract(sheet, ".xlsx")[1] == "item qty\n7 in"
    show = office({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>slide {i}</a:t></a:p></p:sld>' for i in (1, 2, 10)})
    assert extract.extract(show, ".pptx")[1] == "slide 1\n\nslide 2\n\nslide 10"
    assert extract.extract(b"PK broken", ".docx")[:3] == ("unreadable", "", "the Office file is damaged")


def test_extract_pdf():
    for packed in (True, False):
        status, text, reason, _ = extract.extract(simple_pdf(["Hello (world)".replace("(", "\\(").replace(")", "\\)"), "Second line of text"], packed), ".pdf")
        assert (status, text, reason) == ("ok", "Hello (world)\nSecond line of text", None)
    table = b"1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    assert pdf.shown(b"\0\1\0\2\0\3", pdf.code_table(table)) == "Hij"
    assert "password" in extract.extract(simple_pdf(["x"]).replace(b"/Root", b"/Encrypt 9 0 R /Root"), ".pdf")[2]
    assert "scan" in extract.extract(simple_pdf([""]), ".pdf")[2]
    assert "cut short" in extract.extract(b"%PDF-1.4\n1 0 obj <<", ".pdf")[2]
    assert extract.extract(b"no pdf", ".pdf")[0] == "unreadable"


def test_extract_never_raises():
    rnd = random.Random(1)
    for ext in (".pdf", ".docx", ".xlsx", ".html", ".txt", ".doc", ".zip", ""):
        for _ in range(15):
            junk = bytes(rnd.randrange(256) for _ in range(rnd.randrange(400)))
            assert extract.extract((b"%PDF-1.4 " if ext == ".pdf" else b"") + junk, ext)[0] in ("ok", "unreadable", "skipped")
    assert extract.extract("naïve".encode("cp1252") + b" cost", ".txt")[1] == "naïve cost"
    assert extract.extract(b"", ".txt")[0] == "unreadable" and extract.extract(b"x", ".png")[0] == "skipped"


def test_scan_folder(spark, tmp_path):
    root = tmp_path / "share"
    for name, body in {"a.txt": b"two words", "sub/b.md": b"# Title here", "sub/copy.txt": b"two words", "x.png": b"\x89PNG", ".git/c.txt": b"no", "~$lock.docx": b"no", "old.doc": b"x", "empty.txt": b"", "s p.pdf": simple_pdf(["Readable text of a page"])}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    got = {x.rel: x for x in files.scan(spark, str(root), "k").collect()}
    assert {k: v.status for k, v in got.items()} == {"a.txt": "ok", "sub/b.md": "ok", "sub/copy.txt": "ok", "x.png": "skipped", "old.doc": "unreadable", "empty.txt": "unreadable", "s p.pdf": "ok"}
    assert got["a.txt"].chash == got["sub/copy.txt"].chash and got["sub/b.md"].folder == "sub" and got["sub/b.md"].ext == ".md"
    known = files.scan(spark, str(root), "k").select("kb_id", "rel", "size", "mtime").toPandas()
    (root / "a.txt").write_bytes(b"three new words")
    assert [x.rel for x in files.scan(spark, str(root), "k", spark.createDataFrame(known)).collect()] == ["a.txt"]


def test_stream_folder(spark, tmp_path):
    from lodestone.streaming import ingest

    root, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    root.mkdir()
    (root / "a.txt").write_text("first text")
    ingest.follow(spark, str(root), "k", table, state).awaitTermination(60)
    (root / "b.txt").write_text("second text")
    ingest.follow(spark, str(root), "k", table, state).awaitTermination(60)
    assert {x.rel: x.text for x in ingest.current(spark, table).collect()} == {"a.txt": "first text", "b.txt": "second text"}


# --- the queries -----------------------------------------------------------------------------


def test_queries_match_sql(spark):
    from lodestone.queries import QUERIES, SQL
    from tests.compare import connect, differences

    con = connect(DATA)
    for name, f in QUERIES.items():
        df = f(spark, DATA)
        if name in SQL:
            assert differences(df, con, SQL[name]) == [], name
        else:
            df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and {*e.oracle_sql()} <= {*e.queries()}


def test_settings(spark, tmp_path):
    from lodestone.plans.knowledge_base import Conflict, Settings, SettingsStore

    store = SettingsStore(spark, str(tmp_path / "s"))
    first = store.save(Settings("a1", "First"))
    store.patch("b2", name="Second", near_threshold=0.6, weights={"readable": 2, "other": 1})
    assert [x.kb_id for x in store.all()][0] in ("a1", "b2") and store.get("b2").weights == {"readable": 2.0} and len(store.all(1)) == 1
    store.patch("a1", notes="by somebody else")
    with pytest.raises(Conflict):
        store.save(first)  # read before that
    assert (store.get("a1").notes, store.get("a1").version) == ("by somebody else", 2)
    for bad in ({"near_threshold": 0.01}, {"near_threshold": 2}, {"weights": {"readable": -1}}, {"weights": {"unique": float("inf")}}):
        with pytest.raises(ValueError):
            store.patch("a1", **bad)
    with pytest.raises(ValueError):
        store.get("../x")
    assert store.delete("a1") and not store.delete("a1") and store.get("a1") is None and store.clear() == 1 and store.all() == []


def test_rescan(spark, tmp_path):
    from lodestone.plans.knowledge_base import Library, SettingsStore

    root = tmp_path / "share"
    (root / "sub").mkdir(parents=True)
    for name, body in {"a.txt": "price list of pipes", "sub/b.txt": "roof manual", "c.png": "x", "d.txt": ""}.items():
        (root / name).write_text(body)
    before = {p: p.read_bytes() for p in root.rglob("*") if p.is_file()}
    library, store = Library(spark, str(tmp_path / "library")), SettingsStore(spark, str(tmp_path / "s"))
    done = []
    first = library.rescan(str(root), "k1", portions=2, on_progress=lambda *x: done.append(x), settings=store)
    assert (first.counts, first.read, first.problems, first.partial, done) == ({"ok": 2, "skipped": 1, "unreadable": 1}, 4, [], False, [(1, 2), (2, 2)])
    assert {p: p.read_bytes() for p in root.rglob("*") if p.is_file()} == before and not store.get("k1").is_partial
    found = lambda q: [x.rel for x in search.search(library.read("postings"), library.read("docs"), q).orderBy("rank").collect()]
    assert found("roof") == ["sub/b.txt"] and found("price") == ["a.txt"]
    (root / "sub/b.txt").write_text("a wall manual, changed")
    (root / "a.txt").unlink()
    (root / "e.txt").write_text("roof beams")
    stopped = library.rescan(str(root), "k1", portions=8, stop=lambda: True, settings=store)
    assert stopped.partial and store.get("k1").is_partial and found("price") == ["a.txt"]  # nothing is dropped
    second = library.rescan(str(root), "k1", settings=store)
    assert second.counts == {"ok": 2, "skipped": 1, "unreadable": 1} and second.read <= 2 and not store.get("k1").is_partial
    assert found("roof") == ["e.txt"] and found("price") == [] and found("wall") == ["sub/b.txt"]
    assert rows(library.read("postings").select("doc_id", "term", "tf")) == rows(index.postings(library.read("docs")).select("doc_id", "term", "tf"))
    library.drop("k1")
    assert library.kbs() == [] and library.read("docs") is None


def test_walk(spark, tmp_path, monkeypatch):
    """The tree is walked level by level; a folder that can't be opened is told, an ignored one isn't looked into, links aren't followed."""
    for name in ("a/b/c/deep.txt", "a/x.txt", ".git/no.txt", "top.txt", "shut/in.txt"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text("some words here")
    (tmp_path / "r/a/loop").symlink_to(tmp_path / "r")
    inner = files._lister

    def lister():
        one = inner()
        return lambda p: [(p, True, 0, 0, "Permission denied")] if p.endswith("/shut") else one(p)

    monkeypatch.setattr(files, "_lister", lister)
    found = files.look(spark, str(tmp_path / "r"), "k")
    assert {x.rel for x in found.seen.collect()} == {"a/b/c/deep.txt", "a/x.txt", "top.txt"}
    assert [(x.path.rsplit("/", 1)[-1], x.reason) for x in found.problems.collect()] == [("shut", "Permission denied")]
    assert {x.rel for x in found.records.collect()} == {"a/b/c/deep.txt", "a/x.txt", "top.txt"}
    assert files.look(spark, str(tmp_path / "none"), "k").problems.count() == 1


def test_formats(tmp_path):
    """Golden texts of every kind of file; legacy formats have advice; a text that is cut says so."""
    golden = {
        ".txt": ("Größe 5".encode(), "Größe 5"), ".md": (b"# A\r\n\r\n\r\n\r\nb", "# A\n\nb"), ".csv": (b"a,b\n1,2", "a,b\n1,2"), ".json": (b'{"a": 1}', '{"a": 1}'), ".log": (b"\xef\xbb\xbfx  y", "x y"),
        ".html": (b"<head>h</head><h1>Title</h1><p>one &amp; two</p><ul><li>x<li>y</ul>", "Title\none & two\nx y"), ".xml": (b"<a><b>text</b> more</a>", "text more"), ".svg": (b"<svg><text>label here</text></svg>", "label here"),
    }
    for ext, (data, text) in golden.items():
        assert extract.extract(data, ext) == ("ok", text, None, None), ext
    for ext, advice in extract.LEGACY.items():
        status, text, reason, _ = extract.extract(b"x", ext)
        assert (status, text) == ("unreadable", "") and advice in reason
    assert extract.extract(b"word " * 100, ".txt", longest=9) == ("ok", "word word", "only the first 9 of 499 characters are kept", None)
    assert not extract.real_words("?!* -- 12 $$ %% ## &&") and extract.real_words("twelve letters")
