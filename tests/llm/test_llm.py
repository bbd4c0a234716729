"""Operators of the subpackage against brute force on small data, and their defined edge cases."""

import itertools
import os
import random
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import batch_dedup, boilerplate, canon, distinctive_terms, encoding_repair, layout_duplicates, markup, mixture, name_variants, term_frequency, tokenize

DATA = "/root/testdata/sf0.001"
LONG = "long text without end " * 20_000
POST = "kb_id string, term string, doc_id string, tf int, n_docs int, tf2 string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def docs(spark, texts, **more):
    """doc_id and text, with columns whose names clash with inner ones."""
    data = [(i, t, "x", 1, "y", "z", None) for i, t in texts]
    return spark.createDataFrame(data, "doc_id string, text string, id string, kind int, key string, found string, n int")


# --- problems 1 and 3 ------------------------------------------------------------------------


def postings(spark):
    rnd = random.Random(2)
    data = [("k", f"t{int(rnd.paretovariate(0.7)) % 60}", f"d{i % 40}", rnd.randint(1, 4), 0, "") for i in range(1500)]
    seen = {}
    data = [seen.setdefault((t, d), (k, t, d, tf, n, x)) for k, t, d, tf, n, x in data]
    data += data[:200] + [("k", None, "d1", 2, 0, ""), ("k", " \u2003", "d2", 1, 0, ""), ("k", "t1", None, 1, 0, ""), ("k", "zz", "d3", None, 0, ""), ("k", "x" * 50_000, "d4", 1, 0, "")]
    return data, spark.createDataFrame(data, POST)


@pytest.fixture(params=["whole", "split"])
def splits(spark, request):
    """Written tables are read back whole, or in pieces of a few hundred bytes, in one order or another."""
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.leafNodeDefaultParallelism": "9"} if request.param == "split" else {}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k in conf:
        spark.conf.unset(k)


def test_counts_however_split(spark, tmp_path, monkeypatch):
    """One file of many documents, each with a repeated row; the way it is split changes between any two scans."""
    from itertools import count

    data = [(f"t{i % 7}", f"d{i // 7}", 1) for i in range(14_000)]
    spark.createDataFrame(data + data[::-1], "term string, doc_id string, tf int").coalesce(1).write.parquet(str(tmp_path / "p"))
    df, step = spark.read.parquet(str(tmp_path / "p")), count()
    inner = term_frequency.cut

    def cut(*args):
        out = inner(*args)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(3000 * (1 + next(step) % 3)))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "8")
        return out

    monkeypatch.setattr(term_frequency, "cut", cut)
    try:
        got, n = term_frequency.term_counts(df)
        assert n == 2000 and {(x.occurrences, x.n_docs) for x in got.collect()} == {(2000, 2000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


@pytest.mark.parametrize("stored", [True, False])
def test_term_counts(spark, tmp_path, stored):
    data, df = postings(spark)
    if stored:  # several files, rows of documents spread over them
        df.repartition(5).write.parquet(str(tmp_path / "p"))
        df = spark.read.parquet(str(tmp_path / "p"))
    cells = {}
    for _, t, d, tf, *_ in data:
        if t and t.strip() and d:
            cells[t, d] = max(cells.get((t, d), 0), tf or 0)
    want = Counter(t for t, _ in cells)
    total = Counter()
    for (t, _), tf in cells.items():
        total[t] += tf
    for heavy in (None, ["t1", "t2"], []):
        got, n = term_frequency.term_counts(df, heavy)
        assert n == len({d for _, d in cells})
        assert {x.term: (x.occurrences, x.n_docs) for x in got.collect()} == {t: (total[t], want[t]) for t in want}
    marks = {x.term: x.mark for x in term_frequency.mark_terms(df).collect()}
    assert marks == {t: "rare" if want[t] < 3 else "common" if want[t] > 0.25 * n else None for t in want}
    assert term_frequency.mark_terms(df.limit(0)).count() == 0


def test_residuals(spark):
    import math

    data, df = postings(spark)
    lengths = {f"d{i}": (None if i % 5 == 0 else 30 + i) for i in range(0, 38)}
    table = spark.createDataFrame([*lengths.items(), ("d1", 31)], "doc_id string, ntok int").withColumn("tf", F.lit("clash"))
    cells = {}
    for _, t, d, tf, *_ in data:
        if t and t.strip() and d:
            cells[t, d] = max(cells.get((t, d), 0), tf or 0)
    sums, totals, n = Counter(), Counter(), Counter(t for t, _ in cells)
    for (t, d), tf in cells.items():
        sums[d] += tf
        totals[t] += tf
    every, grand = len({d for *_, d, _, _, _ in [(k, t, d, a, b, c) for k, t, d, a, b, c in data] if d}), sum(sums.values())
    weight = {(d, t): tf / (lengths.get(d) or sums[d]) * math.log(every / n[t]) for (t, d), tf in cells.items() if lengths.get(d) or sums[d]}
    got = {(x.doc_id, x.term): x for x in distinctive_terms.residuals(df, table).collect()}
    assert got.keys() == weight.keys()
    for k, x in got.items():
        e = sums[k[0]] * totals[k[1]] / grand
        assert math.isclose(x.weight, weight[k], abs_tol=1e-9) and math.isclose(x.expected, e)
        assert e == 0 or math.isclose(x.residual, (cells[k[1], k[0]] - e) / math.sqrt(e), abs_tol=1e-9)
    some = distinctive_terms.residuals(df, table, min_weight=0.1, min_docs=2)
    assert {(x.doc_id, x.term) for x in some.collect()} == {k for k, w in weight.items() if w >= 0.1 and n[k[1]] >= 2}
    assert distinctive_terms.residuals(df.limit(0), table).count() == 0


# --- problem 2 -------------------------------------------------------------------------------

CLEAN = ["Où ranger les échelles près de l’entrepôt après l’été ?", "Der Prüfer muss die Schlüssel für die Gerätewartung zurückgeben.", "Порядок работ на складе после обеда", "La contaduría anotó las pólizas según el año", "The café paid £30 – not €40.", "±0.75 mm at √75 load, Ø 75 mm × 3", "É preciso verificar a ligação da câmara fria"]


def test_repair(spark):
    ways = [("utf-8", "cp1252"), ("utf-8", "latin_1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp850")]
    garble = lambda t, a, b: encoding_repair.decode(t.encode(a), b)
    texts = [(f"c{i}", t) for i, t in enumerate(CLEAN * 30)]
    bad, want = [], {}
    for i, t in enumerate(CLEAN[:2] + CLEAN[3:4]):
        for a, b in ways[:4]:
            bad.append((f"b{i}{a}{b}", garble(t, a, b)))
            want[bad[-1][0]] = t
    bad.append(("twice", garble(garble(CLEAN[1], "utf-8", "cp1252"), "utf-8", "cp1252")))
    want["twice"] = CLEAN[1]
    half = CLEAN[0].split(" ")
    bad.append(("places", " ".join([*half[:4], *(garble(w, "utf-8", "cp1252") for w in half[4:])])))
    want["places"] = CLEAN[0]
    bad += [("lost", "Proc\ufffddure"), ("null", None), ("empty", ""), ("ascii", "plain"), (None, "Ã©"), ("long", "Où ranger ? " * 20_000)]
    df = docs(spark, texts + bad + bad[:1])
    got = {x.doc_id: x.text for x in encoding_repair.garbled(df).collect()}
    assert got.keys() == {*want, "lost"}
    assert sum(got[k] == v for k, v in want.items()) >= 0.85 * len(want), {k: got[k] for k in want if got[k] != want[k]}
    assert encoding_repair.garbled(df.limit(0)).count() == 0


def test_repair_escapes_and_swaps(spark):
    garble = lambda t, a, b: encoding_repair.decode(t.encode(a), b)
    texts = [(f"c{i}", t) for i, t in enumerate(CLEAN * 30)] + [("html", "<p>D&eacute;j&agrave; pr&ecirc;t&nbsp;&ndash; l&rsquo;&eacute;t&eacute; &amp; apr&egrave;s</p>"), ("json", '{"a": "caf\\u00e9 \\ud83d\\ude00"}')]
    good = "Der Prüfer muss die Schlüssel zurückgeben"
    wrong = garble(good, "utf-8", "latin_1")
    bad = {
        "named": "Der Pr&Atilde;&frac14;fer muss die Schl&Atilde;&frac14;ssel zur&Atilde;&frac14;ckgeben", "twice": "Der Pr&amp;Atilde;&amp;frac14;fer muss die Schl&amp;Atilde;&amp;frac14;ssel zur&amp;Atilde;&amp;frac14;ckgeben",
        "number": "".join(c if c.isascii() else f"&#{ord(c)};" for c in wrong), "backslash": "".join(c if c.isascii() else f"\\u{ord(c):04x}" for c in wrong),
        "swapped": garble(encoding_repair.decode(good.encode(), "cp1252"), "cp1252", "cp850"),
    }
    got = {x.doc_id: x.text for x in encoding_repair.garbled(docs(spark, texts + [*bad.items(), ("lost", "Proc&#65533;dure")])).collect()}
    assert got == dict.fromkeys(bad, good) | {"lost": "Proc&#65533;dure"}


def test_repair_in_any_order():
    """A word's repair doesn't depend on the words before it."""
    rnd, garble = random.Random(3), lambda t, a, b: encoding_repair.decode(t.encode(a), b)
    words = {w for t in CLEAN for w in t.split()}
    held = Counter(p for w in words for p in encoding_repair.pairs(w) for _ in range(30))
    words |= {garble(w, "utf-8", b) for w in words for b in ("cp1252", "latin_1", "cp437") if garble(w, "utf-8", b)}
    model = encoding_repair.Plausibility(200, held)
    want = {w: encoding_repair.Repair(model)(w) for w in words}
    for _ in range(5):
        repair, order = encoding_repair.Repair(model), rnd.sample(sorted(words), len(words))
        assert {w: repair(w) for w in order} == want


def test_character_model_counts_all(spark):
    import math

    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, "né").otherwise("no").alias("text"))
    model = encoding_repair.character_model(df)
    assert model.of["né"] == math.log(40_001 / 40.2) and model.unknown == math.log(40_001 / 0.2)


# --- problem 4 -------------------------------------------------------------------------------


def test_layout_groups(spark):
    texts = [("a", "Price  List\n5,00"), ("b", "price list 500"), ("c", "PRICE-LIST: 500!"), ("d", "price list 501"), ("e", "Cafe\u0301 au lait"), ("f", "CAFÉ AU LAIT"), ("g", "cafe au lait"), ("h", "size: 5\ncolour: red"), ("i", "Colour = red\nsize = 5"), ("j", "colour: 5\nsize: red"), ("k", '{"size": 5, "colour": "red"}'), ("l", '{"colour": "RED", "size": "5"}'), ("m", "size;colour\n5;red"), ("n", "colour\tsize\nred\t5"), ("o", "  "), ("p", "?!"), ("q", None), ("r", ""), (None, "price list 500"), ("s", LONG), ("t", LONG.upper())]
    got = rows(layout_duplicates.layout_groups(docs(spark, texts + texts[:2])))
    # i has h's fields and k's letters in order, so k, l and their kin belong together; n has the letters of i's names first
    groups = defaultdict(set)
    for first, other in got:
        groups[first].add(other)
    assert groups["a"] == {"b", "c"} and groups["e"] == {"f"} and groups["s"] == {"t"}
    joined = {"h", "i", "k", "l"}
    assert joined <= groups["h"] | {"h"} and "j" not in groups["h"] and "g" not in {x for g in groups.values() for x in g} and "n" in {x for g in groups.values() for x in g}
    assert layout_duplicates.layout_groups(docs(spark, texts[:1]).limit(0)).count() == 0
    sizes = {x.doc_id: x.copies for x in layout_duplicates.collapse(docs(spark, texts)).collect()}
    assert sizes["a"] == 3 and sizes["d"] == 1 and sum(sizes.values()) == 20


def test_hot_group(spark, splits):
    """A third of all rows in one group, over the edges of partitions."""
    rnd = random.Random(4)
    texts = [(f"{i:05}", "Hot  content" if i % 3 == 0 else f"text {rnd.randrange(800)}") for i in range(3000)]
    first, want = {}, set()
    for i, t in texts:
        k = canon.letters(t)
        if first.setdefault(k, i) != i:
            want.add((first[k], i))
    assert {*rows(layout_duplicates.layout_groups(docs(spark, texts).repartition(7)))} == want


def test_long_fields(spark):
    name, cell = "n" * 300, "c" * 200_000
    texts = [("a", f"{name}: 1\nsize: 2"), ("b", f"size: 2\n{name}: 1"), ("c", f"x;y\n{cell};1"), ("d", f"y;x\n1;{cell}")]
    assert rows(layout_duplicates.layout_groups(docs(spark, texts))) == [("a", "b"), ("c", "d")]


def test_equal_digests(spark, monkeypatch):
    """Were full keys to share a digest, records would still be grouped by their full keys."""
    monkeypatch.setattr(layout_duplicates, "adjacent_copies", lambda keys: keys.where("id <> 'a'").selectExpr("kind", "'a' as first_id", "id"))
    texts = [("a", "one"), ("b", "ONE"), ("c", "two"), ("d", "Two!"), ("e", "three")]
    assert rows(layout_duplicates.layout_groups(docs(spark, texts))) == [("a", "b"), ("c", "d")]


# --- problem 5 -------------------------------------------------------------------------------


def test_markup():
    page = "<html><head><title>x</title><script>var a=1</script></head><body><nav><a href='/'>Home</a> <a href='/c'>Contact</a></nav><h1>Rates &amp; terms</h1><p>Work costs <b>5</b> &euro; in this yard.</p><ul><li>one thing to do<li>two things to do</ul><table><tr><td>a</td><td>1</td></tr></table><pre><code>x = 1\n  y</code></pre><span class=\"math\">a_1 + b</span></body></html>"
    found, text, blocks = markup.convert(page)
    assert found == ["html"] or "html" in found
    kinds = [k for k, *_ in blocks]
    assert [*dict.fromkeys(kinds)] == ["heading", "text", "item", "row", "code", "formula"]
    assert "Rates & terms" in text and "5 € in" in text and "- one thing" in text and "a\t1" in text and "    x = 1\n      y" in text and "var a" not in text and "Home" not in text
    md = "# Title here\n\nSome **bold** text with [a link](x.md) and _more_.\n\n- first\n- second\n\n1. one\n2. two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode *here*\n```\n\n$$x^2$$\n"
    _, text, blocks = markup.convert(md)
    assert text == "Title here\n\nSome bold text with a link and more.\n\n- first\n- second\n1. one\n2. two\n\na\tb\n1\t2\n\n    code *here*\n\nx^2"
    wiki = "== Head ==\n'''Bold''' and [[Page|shown]] here.\n{| class=x\n|-\n| a || b\n|}\n<code>\nz = 2\n</code>"
    assert markup.convert(wiki)[1].startswith("Head\n\nBold and shown here.") and "a\tb" in markup.convert(wiki)[1]
    tex = "\\documentclass{article}\n\\begin{document}\n\\section{Intro}\nA \\emph{b} costs 5 \\% more~\\ref{x}.\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}\n\\end{document}"
    assert markup.convert(tex)[1] == "Intro\n\nA b costs 5 % more.\n\n- one\n- two\n\na\tb"
    for fine in ["We ordered 3 * 4 boxes, so 12 in all.", "Hourly cost is between $5 and $7, plus parts.", "must stay < 30 bar and > 28 bar", "Write to <desk4@some.example> now", "C:\\jobs\\north\\6\\new_index", "clause 3^1, 'x_1', fleet_plan_v3_final", "limit {2, 3}, see [5] # 4", '{"a": ["x", 1]}', "R&D or Q&A", "", "a | b | c", "├── invoices"]:
        assert markup.convert(fine) is None, fine
    for one in ["text &nbsp; more", "end<br>", "see [x](y.md) ok", "{{note|x}} '''urgent'''", "a \\textbf{b} c", "```\nx\n```", "&lt;p&gt;text"]:
        assert markup.convert(one), one


def test_wiki_tables():
    def shown(text):
        tree = markup.Tree()
        markup.parse_lines(text, tree, 0)
        return [(x.kind, x.text) for x in tree.nodes if x.text], sum(x.kind == "row" for x in tree.nodes)

    text = lambda *x: [("text", t) for t in x]
    assert shown("{| class=x\n|-\n| one\nmore of one\n# and this\n\n| two\n|-\n| three\n|}\nAfter.") == (text("one more of one # and this", "two", "three", "After."), 2)
    assert shown("{| class=x\n| one\n| two\n\nA paragraph.\n\nAnother.") == (text("one", "two", "A paragraph.", "Another."), 1)
    assert shown("Before.\n\n{|\n| one") == (text("Before.", "one"), 1)
    assert shown("{|\n| one\nText.\n\n{|\n| two\n{|\n| in\n|}\n| three\n|}\nEnd.") == (text("one", "Text.", "two", "in", "three", "End."), 4)
    assert shown("A brace {| in a line\n{| and here\nEnd.")[0] == text("A brace {| in a line\n{| and here\nEnd.")


def clean_documents():
    """Documents of the test tables without a sign of markup."""
    import re

    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/docs.parquet", columns=["text"]).column(0).to_pylist()
    signs = re.compile(markup._SIGNS.replace("(?m)", ""), re.M)
    return [*dict.fromkeys(t for t in texts if t and 150 <= len(t) <= 6000 and not signs.search(t))]


def test_markup_content_kept():
    """Of held-out documents written as pages, what is lost, and what stays of what stood around them in parts of their own."""
    texts = clean_documents()
    model, rnd = markup.trained(texts[::2]), random.Random(7)
    lost = total = kept = around = 0
    for text in texts[1::2]:
        page, content = markup._page(rnd, text)
        got = markup.convert(page, model)
        have, need = Counter(markup._BARE(got[1] if got else page).split()), Counter(markup._BARE(content).split())
        lost += sum(len(w) * n for w, n in (need - have).items())
        total += sum(len(w) * n for w, n in need.items())
        outer = markup.parse(page)
        for x, p in zip(outer.nodes, model.marginals(outer)):
            if x.kind in ("nav", "footer", "hidden", "form"):
                around += 1
                kept += p >= markup.KEPT
    assert len(texts) > 150 and lost < 0.01 * total and around > 100 and kept < 0.1 * around
    for page, text in {"<p><a href='x'>Read the full pump manual here</a></p>": "Read the full pump manual here", "<ul><li><a href='a'>Pump manual</a><li><a href='b'>Roof guide</a></ul>": "- Pump manual\n- Roof guide", "<textarea>Some text to keep</textarea>": "Some text to keep", "<noscript>Keep me please</noscript><p>x</p>": "Keep me please\n\nx"}.items():
        assert markup.convert(page, model)[1] == text
    formula = "$$\n" + "x + y\n" * 80 + "$$"
    assert [k for k, *_ in markup.convert(formula, model)[2]] == ["formula"]
    assert markup.convert(f"*{'very long emphasis ' * 30}here* it is", model)[1].startswith("very long")


def test_markup_model():
    """Held-out accuracy of the marginals on labelled pages; marks of plain sentences and of markup."""
    texts = clean_documents()
    model = markup.trained(texts[::2])
    right = total = 0
    for tree, labels in markup.labelled_pages(texts[1::2], seed=2):
        for p, s in zip(model.marginals(tree), labels):
            right += (p >= 0.5) == bool(s)
            total += 1
    assert right / total > 0.95
    tree, _ = next(x for x in markup.labelled_pages(texts, seed=3) if len(x[0].nodes) > 12)
    while len(tree.nodes) > 9:
        tree.nodes.pop()
    for x in tree.nodes:
        x.children = [c for c in x.children if c < len(tree.nodes)]
    # brute force over all labellings of a small tree
    import math

    own = [[sum(model.evidence.get(f, (0, 0))[s] for f in fs) for s in (0, 1)] for fs in markup.features(tree)]
    mass = [[0.0, 0.0] for _ in tree.nodes]
    for states in itertools.product((0, 1), repeat=len(tree.nodes)):
        w = model.root[states[0]] + sum(own[i][s] for i, s in enumerate(states)) + sum(model.edge[states[x.parent]][states[i]] for i, x in enumerate(tree.nodes) if i)
        for i, s in enumerate(states):
            mass[i][s] += math.exp(w)
    assert all(abs(p - m[1] / sum(m)) < 1e-9 for p, m in zip(model.marginals(tree), mass))


def test_markup_table(spark):
    df = docs(spark, [("a", "<p>x</p>"), ("b", "plain"), ("c", None), ("d", ""), (None, "<p>"), ("e", "<p>" + LONG + "</p>"), ("f", "<div>" * 3000 + "deep")])
    got = {x.doc_id: x for x in markup.cleaned(df).collect()}
    assert got.keys() == {"a", "e", "f"} and got["a"].text == "x" and len(got["e"].text) > 400_000 and got["f"].text == "deep"
    assert markup.cleaned(df.limit(0)).count() == 0


# --- problem 6 -------------------------------------------------------------------------------


def arrivals_fixture():
    rnd = random.Random(5)
    vocabulary = [f"word{i}" for i in range(60)]
    common = " ".join(vocabulary[:30])
    old = [(f"h{i}", " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 60)))) for i in range(80)] + [("same", common), ("null", None), ("empty", "")]
    new = []
    for i in range(120):
        if i % 3 == 0:
            w = (rnd.choice(old[:80])[1]).split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = "edit"
            new.append((i, " ".join(w)))
        elif i % 3 == 1:
            new.append((i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 50)))))
        else:
            new.append((i, common + f" tail {i} " * (i % 7)))  # a third of all are copies of one text
    return old, new + [(200, None), (201, ""), (202, "?!"), (203, "Word1, WORD2 word3"), (204, "word1 word2 - word3"), (205, LONG), (206, LONG)]


def brute_repeats(old, new):
    runs = lambda t: {tuple(w[i : i + 5]) for w in [canon.words(t)] for i in range(len(w) - 4)}
    seen = [(canon.letters(t), runs(t)) for _, t in old if t]
    out = set()
    for i, t in new:
        if not t or not canon.letters(t):
            continue
        k, r = canon.letters(t), runs(t)
        if any(k == a or (r and b and len(r & b) / len(r | b) >= 0.55) for a, b in seen):
            out.add(i)
        seen.append((k, r))
    return out


@pytest.mark.parametrize(("look", "portion"), [(64, 8_000_000), (1, 300)])
def test_repeated_arrivals(spark, monkeypatch, look, portion):
    monkeypatch.setattr(batch_dedup, "LOOK", look)  # also with runs whose holders aren't all looked at at first, and in several passes
    monkeypatch.setattr(batch_dedup, "PASS_RUNS", portion)
    old, new = arrivals_fixture()
    a = spark.createDataFrame([(i, t, "x", 1) for i, t in [*new, (None, "word")]], "arrival_id long, text string, sid string, ord int")
    want = brute_repeats(old, new)
    history = docs(spark, [*old, (None, old[3][1]), (None, old[4][1])]).repartition(5)
    assert {x.arrival_id for x in batch_dedup.repeated_arrivals(history, a.repartition(3)).collect()} == want and len(want) > 50
    assert batch_dedup.repeated_arrivals(docs(spark, old).limit(0), a.limit(0)).count() == 0


def test_copies_in_other_words(spark):
    """A record is compared with every copy of a content, as copies may differ in their words."""
    w = [f"wordy{i}" for i in range(40)]
    split = " ".join(x.replace("wordy", "wo rdy") for x in w)
    edited = " ".join([*w[:20], "changed", *w[21:]])
    history = docs(spark, [("a", split), ("b", " ".join(w))])
    a = spark.createDataFrame([(1, edited)], "arrival_id long, text string")
    assert [x.arrival_id for x in batch_dedup.repeated_arrivals(history, a).collect()] == [1]
    b = spark.createDataFrame([(1, split), (2, " ".join(w)), (3, edited)], "arrival_id long, text string")
    assert {x.arrival_id for x in batch_dedup.repeated_arrivals(history.limit(0), b).collect()} == {2, 3}


def test_history(spark, monkeypatch):
    old, new = arrivals_fixture()
    new = new[:120]
    none, nothing = docs(spark, []).limit(0), spark.createDataFrame([], "arrival_id long, text string")
    history = batch_dedup.History(spark)
    history.add(batch_dedup.records(docs(spark, old), nothing))
    made = []
    inner = batch_dedup.blocks_of
    monkeypatch.setattr(batch_dedup, "blocks_of", lambda rows, keep_all: made.append(rows.count()) or inner(rows, keep_all))
    got = set()
    for at in range(0, 120, 40):
        got |= {x.ord for x in history.accept(batch_dedup.records(none, spark.createDataFrame(new[at : at + 40], "arrival_id long, text string"))).collect()}
    assert got == brute_repeats(old, new)
    assert made == [40, 40, 40]  # only texts of the batch are read; segments have none
    assert "text" not in spark.read.parquet(history.segments[0].path).columns
    sizes = [s.records for s in history.segments]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) < 4


def test_segments_have_small_row_groups(spark):
    """A reader decodes a row group's blocks together; with all blocks of a file in one, executors ran out of memory."""
    old, new = arrivals_fixture()
    history = batch_dedup.History(spark)
    blocks = batch_dedup.blocks_of(batch_dedup.old_records(docs(spark, old)).repartition(20), keep_all=False)
    history._append(history._write(blocks.coalesce(1)))
    groups = [f.metadata.row_group(i).num_rows for p in Path(history.segments[0].path).glob("*.parquet") for f in [pq.ParquetFile(p)] for i in range(f.num_row_groups)]
    assert sum(groups) > 10 and max(groups) <= 4
    got = {x.ord for x in history.accept(batch_dedup.new_records(spark.createDataFrame(new, "arrival_id long, text string"))).collect()}
    assert got == brute_repeats(old, new)


# --- problem 7 -------------------------------------------------------------------------------


def test_segment_join(spark):
    rnd = random.Random(6)
    names = {"".join(rnd.choice("abcdelmno") for _ in range(rnd.randint(6, 12))) for _ in range(60)}
    for n in [*names][:60]:
        for _ in range(3):
            w = list(n)
            for _ in range(rnd.randint(1, 3)):
                at = rnd.randrange(len(w))
                pick = rnd.randrange(4)
                if pick == 0:
                    w[at] = rnd.choice("abz")
                elif pick == 1:
                    w.insert(at, "z")
                elif pick == 2 and len(w) > 6:
                    del w[at]
                elif at + 1 < len(w):
                    w[at], w[at + 1] = w[at + 1], w[at]
            names.add("".join(w))
    got = {(x.a, x.b): x.d for x in name_variants.similar_names(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    # one error of any kind leaves two of four segments whole
    want = {(a, b): 1 for a, b in itertools.combinations(sorted(names), 2) if name_variants.distance(a, b, 1) == 1}
    assert got == want and len(want) > 50
    some = spark.createDataFrame([(n,) for n in sorted(names)[::7]], "n string")
    pairs = name_variants.similar_names(spark.createDataFrame([(n,) for n in names], "n string"), "n", some)
    assert {(x.a, x.b) for x in pairs.collect()} == {p for p in want if {*p} & {*sorted(names)[::7]}}
    assert name_variants.distance("ab", "ba", 2) == 1 and name_variants.distance("abc", "xyz", 2) == 3


def test_name_variants(spark):
    groups = [
        ["Henry Keravmorlin", "HENRY KERAVMORLIN", "Keravmorlin, Henry", "H. Keravmorlin", "hkeravmorlin", "henry.keravmorlin", "Harry Keravmorlin", "Henry Kearvmorlin", "Henry B. Keravmorlin", "Hery Keravmorlin", "Henry  Keravmorlin"],
        ["Richard Keravmorlin", "R. Keravmorlin"], ["José Paronsovre", "Jose Paronsovre", "Pepe Parosovre"],
        ["Lazafor Manufacturing Limited", "LAZAFOR MANUFACTURING, LTD", "The Lazafor Mfg. Ltd", "Manufacturing Lazafor Ltd", "Lazafor-Manufacturing Limited", "Lazafor Manufacturing", "Lazaofr Manufacturing Limited"], ["Lazafor Transport Limited"],
        ["Anna Rolodrecott"], ["Anton Rolodrecott"],
    ]
    data = [(a,) for g in groups for a in g] * 2 + [("admin",), ("n/a",), (None,), ("",), ("  ",), ("A. Rolodrecott",), ("x" * 5000,)]
    df = spark.createDataFrame(data, "author string").withColumn("entity", F.lit("clash"))
    nick = spark.createDataFrame([("Henry", "Harry"), ("José", "Pepe"), ("Richard", None), (None, "x")], "given_name string, nickname string")
    want = {(a, b) for g in groups for a, b in itertools.combinations(sorted(g), 2)}
    assert {*rows(name_variants.variant_pairs(df, nick))} == want
    assert name_variants.variant_pairs(df.limit(0), nick.limit(0)).count() == 0


def test_names_beyond_the_lists(spark):
    """Legal forms in no list, ends of firms' names learned from the data, short given names with an error, initials without a full name."""
    groups = [
        ["Keravmorlin Oy", "KERAVMORLIN OY", "The Keravmorlin Oy"], ["Keravmorlin Bakery S.p.A.", "Keravmorlin Bakery SpA"], ["Lazafor B.V.", "Lazafor BV", "Lazaofr BV"],
        ["Derinlo Zawod", "DERINLO ZAWOD", "Derinol Zawod"], ["Ann Rolodrecott", "Anm Rolodrecott"], ["Q. Hervestonn", "Q. Hervetsonn"],
    ]
    more = [f"{x}{y} Zawod" for x, y in itertools.product(["Mibra", "Tolke", "Vanso", "Petri"], ["long", "mund", "karst"])] + [f"Ann {x}" for x in ("Belmondo", "Carstairs", "Dunwoody", "Ellsworth")]
    df = spark.createDataFrame([(a,) for g in groups for a in g] + [(a,) for a in more], "author string")
    nick = spark.createDataFrame([], "given_name string, nickname string")
    want = {(a, b) for g in groups for a, b in itertools.combinations(sorted(g), 2)}
    assert {*rows(name_variants.variant_pairs(df, nick))} == want
    kinds = {x: name_variants.Reader({})(x)[0] for x in ("Keravmorlin Oy", "Keravmorlin B.V.", "Keravmorlin Bakery S.p.A.")}
    assert {*kinds.values()} == {"firm"} and name_variants.Reader({"maria": "maria"})("Maria Sa")[0] == "person"


# --- problem 8 -------------------------------------------------------------------------------


def test_tokenize(spark):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    folder = tokenize.TOKENIZERS
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb"))}
    exact = tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(7)
    texts = ["", " ", "\n\n", "<|endoftext|>", "naïve Straße 🙂👍🏽 ﬀ\u200b", "a" * 3000, LONG, "don't we'll\t\tx", *("".join(rnd.choice("abcdefstheringo AEx0123é漢\n'") for _ in range(rnd.randint(1, 200))) for _ in range(300))]
    df = docs(spark, [*((str(i), t) for i, t in enumerate(texts)), ("null", None)]).withColumn("ids", F.lit(1))
    got = {x.doc_id: x.ids for x in tokenize.encode(df).collect()}
    assert got.pop("null") == [] and len(got) == len(texts)
    assert all(got[str(i)] == exact.encode_ordinary(t) for i, t in enumerate(texts))
    assert {x.doc_id: x.n_tokens for x in tokenize.count_tokens(df, ["doc_id"]).collect()} == {k: len(v) for k, v in got.items()} | {"null": 0}
    assert tokenize.encode(df.limit(0)).count() == 0
    v = tokenize.vocabulary(os.path.join(folder, "byte_bpe_50k.json"))
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 30))).encode() for _ in range(3000)]
    found, failed = v.encode_words(words)
    assert found == [v.exact(w) for w in words] and 0 < failed < len(words)


# --- problem 9 -------------------------------------------------------------------------------


def test_mixture(spark, splits):
    rnd = random.Random(8)
    data = [(i, rnd.choice(["a", "a", "a", "a", "b", "c", "out", None]), " ".join(["word"] * rnd.randint(0, 40)) if i % 30 else None, 1, "k") for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string, uses int, key string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 9), ("c", 0.3, 1), ("none", 0.0, 3), (None, 0.5, 1), ("d", None, None)], "source string, target_share double, max_repeats int")
    for seed, fill in ((0, False), (3, False), (0, True)):
        m = mixture.mix(df, targets, seed, fill)
        used = m.documents.collect()
        size, caps = Counter(), {"a": 2, "b": 9, "c": 1}
        for x in used:
            size[x.source] += x.n_tokens
            assert 0 <= x.uses <= caps[x.source]
        assert len(used) == sum(s in caps for _, s, *_ in data)
        total, longest = sum(size.values()), max(x.n_tokens for x in used)
        got = Counter()
        for x in used:
            got[x.source] += x.n_tokens * x.uses
        if not fill:
            for s, share in (("a", 0.3), ("b", 0.4), ("c", 0.3)):
                assert abs(got[s] - min(share * total, caps[s] * size[s])) <= longest / 2 + 1
        else:
            assert abs(sum(got.values()) - total) <= 3 * longest
        shares = {x.source: x for x in m.shares.collect()}
        assert shares["none"].tokens == 0 and abs(sum(x.share or 0 for x in shares.values()) - 1) < 1e-9 and all(shares[s].tokens == got[s] for s in caps)
        # within an epoch a source's uses differ by one at most
        assert all(max(u) - min(u) <= 1 for s in caps for u in [[x.uses for x in used if x.source == s and x.n_tokens]])
    assert mixture.mix(df.limit(0), targets).documents.count() == 0 and mixture.mix(df, targets.limit(0)).documents.count() == 0


# --- problem 10 ------------------------------------------------------------------------------


def test_boilerplate(spark):
    real = "The crew will weigh the cards and leave the car park tidy. Send the papers with code B-84 to the yard before noon every quarter."
    bad = {
        "field": f"{real}\n\nDear {{{{client_name}}}}, thank you for calling us.", "insert": f"{real}\nInvoice to: [INSERT company] (Lorant Ltd)", "lorem": f"{real}\n\nLorem ipsum valdor amore fretum galda ipsum nostri tectum quora.", "dummy": f"{real}\nThis is dummy copy to show how the page will look.",
        "blah": "blah blah blah blah blah blah blah blah", "e404": "404 Not Found\n\nThe address /files/x/1 was not found on this server.", "js": "Ann & Co | Home | Jobs\nYou need to enable JavaScript to run this app. kosenl 9", "trace": 'Traceback (most recent call last):\n  File "/opt/x/view.py", line 3, in load\nKeyError: \'a\'',
    }
    good = {
        "real": real, "about": f"{real}\nIn the letter template, {{{{client_name}}}} is filled from the job card.", "set": f"{real}\nSet ${{BACKUP_DIR}} to the x volume, then start.", "said": f"{real} {real}\nIf the portal shows “404 Not Found”, the share was renamed; Ann keeps the list.",
        "staff": f"{real} {real}\nStaff must enable JavaScript in the browser before the first time card.", "ipsum": f"{real}\nThe designer used lorem ipsum in the first draft, and the client approved it.", "pad": f"{real} [PAD] [SEP]", "null": None, "empty": "", "blank": " \n ", "long": LONG,
    }
    data = [(i, t, s, 5, "x") for (i, t), s in zip([*bad.items(), *good.items(), *bad.items()], itertools.cycle(["a", "b", None]))]
    df = spark.createDataFrame([*data, (None, bad["e404"], "a", 1, "")], "doc_id string, text string, source string, size int, form string")
    assert {x.doc_id for x in boilerplate.residue(df).collect()} == bad.keys()
    kept = boilerplate.without_residue(df)
    assert {x.doc_id for x in kept.collect()} == {*good, None} and kept.columns == df.columns or {*kept.columns} == {*df.columns}
    assert boilerplate.residue(df.limit(0)).count() == 0


UNSEEN = ["The requested resource could not be located.", "Something went wrong on our side.", "This website requires scripting to work.", "Bad request", "Your connection was refused by the gateway", "Der Server konnte die Anfrage nicht bearbeiten.", "Cette ressource n’existe plus sur le serveur, réessayez plus tard.", "Se produjo un error inesperado en el servidor", "Страница не найдена", "Η σελίδα δεν βρέθηκε"]


def test_unseen_notices(spark):
    """Messages in no list of phrases are found where they recur over sources, with other numbers and addresses in each, however long
    the page; sentences of the same words within real content aren't, nor a message that doesn't recur."""
    real = "The crew will weigh the cards and leave the car park tidy, and the clerk adds each of them to the list of the yard before noon."
    bad = {f"{i}-{k}": f"{x} 1{k}:30 /srv/{k}/x\n" * (200 if k == 0 else 1) for i, x in enumerate(UNSEEN) for k in range(6)}
    good = {f"g{i}-{k}": f"{real} {real}\n{x}\n{real}" for i, x in enumerate(UNSEEN) for k in range(6)} | {"once": "The login of this application was interrupted"}
    data = [(i, t, f"s{n % 3}") for n, (i, t) in enumerate([*bad.items(), *good.items()])]
    df = spark.createDataFrame(data, "doc_id string, text string, source string")
    assert {x.doc_id for x in boilerplate.residue(df).collect()} == bad.keys()


def test_fields_and_filler():
    for x in ["Dear «FirstName», we wrote.", "Prezado __ClientName__, segue o recibo.", "Name: ________", "Dear <%= user.name %>,", "Hello *|FNAME|*", f"{'We met. ' * 80}Dear {{{{name}}}}, thank you.", "Dear {{name}}, your volume discount is {{rate}}"]:
        assert boilerplate.judged_line(x)[0] & boilerplate.ADDRESSED, x
    for x in ["« abîmé », a écrit le chef", "Mail-merge fields such as «FirstName» draw on the sheet.", "In the letter template, {{client_name}} is filled from the job card.", "The [signed] copy and the [scanned] copy are both kept."]:
        assert not boilerplate.judged_line(x)[0] & (boilerplate.ADDRESSED | boilerplate.FIELDED), x
    for x in ["asdf jkl asdf qwer", "test test test test", "Dolor sit amet consectetur adipiscing elit sed", "blah blah blah blah blah blah blah blah blah"]:
        assert boilerplate.judged_line(x)[0] == boilerplate.FILLER, x


# --- the queries -----------------------------------------------------------------------------


def test_queries(spark):
    from lodestone.llm.queries import QUERIES, SQL
    from tests.compare import connect, differences

    con = connect(DATA)
    for name, f in QUERIES.items():
        df = f(spark, DATA)
        if name in SQL:
            assert differences(df, con, SQL[name]) == [], name
        else:
            df.count()
