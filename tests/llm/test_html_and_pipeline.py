"""HTML extraction on pages made by hand, and the pipeline's stages against the operators they call."""

import random
import re

import pytest

import corpus_pipeline
from weftgraph.llm import htmlextract, quality, simhash, toxicity
from weftgraph.llm.common import table

SHELL = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><header>Site</header>%s<aside>More</aside><div class='comments'><p>First!</p></div><form>Mail</form><script>x</script><footer>(c)</footer></body></html>"


def text_of(html):
    page = htmlextract.parse(html)
    return "\n".join(page.blocks[k] for k in htmlextract.by_names(page))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (SHELL % "<article><h1>A &amp; B</h1><p>One\n  two<br>three <b>bold</b>.</p><p>Four</p></article>", "A & B\nOne two three bold.\nFour"),
        (SHELL % "<main><p>Only <a href='x'>main</a></p><ul><li>a<li>b</ul></main>", "Only main\na\nb"),
        (SHELL % "<div><p>Plain &eacute;&#33;</p></div>", "Plain é!"),
        ("<p>un<!-- no -->closed <i>text", "unclosed text"),
        ("", ""),
        (None, ""),
        ("no markup", "no markup"),
    ],
)
def test_blocks(html, want):
    assert text_of(html) == want


def largest_matching(a, b):
    """Simple tree matching by its definition; trees are (name, blocks of a run, children)."""
    if a[0] != b[0]:
        return 0
    if not a[2] or not b[2]:
        return min(a[1], b[1]) if a[0].endswith("#") else 1
    best = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2]):
        for j, y in enumerate(b[2]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + largest_matching(x, y))
    return 1 + best[-1][-1]


def nested(page, i=0):
    return page.names[i], page.hi[i] - page.lo[i] if page.names[i].endswith("#") else 0, [nested(page, c) for c in page.children()[i]]


def random_page(rng, depth=0):
    if depth == 4 or rng.random() < 0.3:
        return "".join(f"<{t}>w{rng.randint(0, 9)}</{t}>" for t in rng.choices(["p", "h2"], k=rng.randint(1, 3)))
    return "".join(f"<{t}>{random_page(rng, depth + 1)}</{t}>" for t in rng.choices(["div", "section", "table"], k=rng.randint(1, 4)))


def test_tree_matching():
    rng = random.Random(11)
    for _ in range(60):
        a, b = htmlextract.parse(random_page(rng)), htmlextract.parse(random_page(rng))
        m = htmlextract.Matching()
        found = m.partners(a, b)
        assert all(a.names[i] == b.names[j] for i, j in found.items())
        assert all((found[a.parent[i]] == b.parent[j]) if i else j == 0 for i, j in found.items())
        at = sorted(found)
        assert [found[i] for i in at] == sorted(found.values())
        size = sum(min(a.hi[i] - a.lo[i], b.hi[j] - b.lo[j]) if a.names[i].endswith("#") else 1 for i, j in found.items())
        assert size == largest_matching(nested(a), nested(b))


def test_long_and_deep_pages():
    m = htmlextract.Matching()
    long = [htmlextract.parse("<article>" + "".join(f"<p>{x}{i}</p><h2>{x}{i}</h2>" for i in range(10000 - k)) + "</article>") for x, k in (("a", 0), ("b", 7))]
    assert len(m.partners(*long)) == 2 + 2 * 9993
    deep = [htmlextract.parse(f"<div>{x}" * n) for x, n in (("a", 5000), ("b", 4800))]
    # the last of b is a run, as it holds nothing but text
    assert len(m.partners(*deep)) == 1 + 2 * 4799
    assert text_of("<div>" * 5000 + "x") == "x"


PAGE = "<div>%(menu)s</div><div>%(ad)s</div><div><h1>%(title)s</h1>%(story)s</div><div>%(foot)s</div>"


def anonymous_pages(n, **more):
    """Pages without a telling name or class: only how slots vary tells the story from the rest."""
    rng = random.Random(7)
    say = lambda k: " ".join(rng.choice(["ember", "tide", "lark", "moss", "quill", "frost"]) + str(rng.randint(0, 99)) for _ in range(k))
    out = []
    for _ in range(n):
        title, story = say(4), [say(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
        menu = "".join(f"<p><a href='/{w}'>{w}</a></p>" for w in say(rng.randint(3, 6)).split())
        page = PAGE % {"menu": menu, "ad": say(6), "title": title, "story": "".join(f"<p>{p}</p>" for p in story) + more.get("inside", ""), "foot": "All rights " + say(3)}
        out.append((page, "\n".join([title, *story])))
    return out


def test_wrapper_tells_slots_apart_without_names(spark):
    made = anonymous_pages(14, inside="<p>Read our daily letter</p><div class='comments'><p>First!</p></div>")
    few = anonymous_pages(2)
    rows = [(i, f"https://h.example/{i}", p, "x") for i, (p, _) in enumerate(made)] + [(100 + i, f"https://o.example/{i}", p, "x") for i, (p, _) in enumerate(few)]
    rows += [(91, None, None, "x"), (92, "https://h.example/92", "", "x"), rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmlextract.extract(pages).collect()}
    for i, (_, want) in enumerate(made):
        assert (got[i].text, got[i].n_chars, got[i].wrapped) == (want, len(want), True)
    assert not got[100].wrapped
    assert (got[91].text, got[92].text) == ("", "")
    off = {r.page_id: r.text for r in htmlextract.extract(pages, induced=False).collect()}
    assert all(off[i] != want for i, (_, want) in enumerate(made))
    assert htmlextract.extract(pages).count() == len(rows)
    assert htmlextract.extract(pages.limit(0)).count() == 0


def test_each_layout_has_its_template(spark):
    """A notice on half of a host's pages goes, though the other half lacks it."""
    made = anonymous_pages(16)
    notice = "<section><div>We moved our office</div></section>"
    rows = [(i, f"https://h.example/{i}", (notice if i % 2 else "") + p) for i, (p, _) in enumerate(made)]
    got = {r.page_id: r.text for r in htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(made)}


def test_copies_are_no_template(spark):
    """A host of near copies keeps its story, though nearly all of it is constant."""
    rows = [(i, f"https://h.example/{i}", f"<div><h1>Same title</h1><p>The same long story on every page of this host.</p><p>Visit {i}</p></div>") for i in range(9)]
    got = htmlextract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == sorted(f"Same title\nThe same long story on every page of this host.\nVisit {i}" for i in range(9))


def test_pages_by_structure_alone(spark, sf_dir):
    """Without its telling names and classes, each page still gives the text that those names tell."""
    pages = table(spark, "/root/testdata/sf0.1", "pages").where("url like '%//www.ththon.example.org/%'")
    plain = lambda h: re.sub(r"<(/?)(nav|article|footer)>", r"<\1div>", h).replace(' class="ad"', "")
    rows = pages.collect()
    bare = spark.createDataFrame([(r.page_id, r.url, plain(r.html)) for r in rows], "page_id long, url string, html string")
    want = {r.page_id: text_of(r.html) for r in rows}
    assert {r.page_id: r.text for r in htmlextract.extract(bare).collect()} == want
    assert all(text_of(plain(r.html)) != want[r.page_id] for r in rows)
    assert {r.page_id: r.text for r in htmlextract.extract(pages).collect()} == want


def test_pipeline_stages(spark, sf_dir):
    """Each stage keeps what its operator, applied on its own, says; the last packs just those documents."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = {
            "quality": lambda d: quality.quality(d).where("kept"),
            "toxicity": lambda d: toxicity.toxicity(d, labels).where("predicted = 0"),
            "near_dedup": lambda d: simhash.near_duplicates(d, shingle=5, distance=7, segments=8).where("doc_id = component_id"),
        }[name](docs)
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert ids(kept) == ids(want)
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert ids(pieces.select("doc_id").distinct()) == ids(docs)
    whole = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r[1] == r[2] for r in whole)


def test_pipeline_of_odd_tables(spark, odd_docs, tmp_path):
    """Nulls, blanks, repeats, clashing names and an empty table go through all stages."""
    labels = spark.createDataFrame([(1, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd_docs), ("none", odd_docs.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in pieces} <= {5}
        if name == "none":
            assert not pieces


def test_near_copies_of_five_words(spark):
    """The stage links texts that differ in a few words, and keeps the least id of each group."""
    rng = random.Random(3)
    say = lambda n: [rng.choice("amber birch cedar dune ember fjord glade heath islet knoll".split()) + str(rng.randint(0, 400)) for _ in range(n)]
    rows, originals = [], []
    for i in range(12):
        words = say(900)
        originals.append(2 * i)
        other = list(words)
        other[450] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == originals


def python_passes(plan) -> list[int]:
    """How many Python passes each task of a plan holds one after another: each of them takes a worker of its own."""
    found, below = [], [(plan, 0)]
    while below:
        node, n = below.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            below.append((node.executedPlan(), n))
            continue
        n += "InArrow" in name or "Python" in name
        found.append(n)
        children = node.children()
        below += [(children.apply(i), 0 if "Exchange" in name else n) for i in range(children.size())]
    return found


def test_a_task_holds_one_python_worker(spark, sf_dir, monkeypatch):
    """No stage gives what one Python pass makes to another in the same task; an executor keeps all workers that it ever had at once."""
    most, frame = [], type(spark.range(0))

    def plans(self, run, *args, f=frame.mapInArrow, **more):
        out = f(self, run, *args, **more)
        most.append(max(python_passes(out._jdf.queryExecution().executedPlan())))
        return out

    monkeypatch.setattr(frame, "mapInArrow", plans)
    corpus_pipeline.run(spark, sf_dir)
    assert len(most) > 10
    assert set(most) == {1}
