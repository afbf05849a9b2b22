import pytest

from granary.llm import markup


def found(text):
    return markup.languages_of(markup.parse(text))


def clean(text):
    return markup.write(markup.parse(text))


@pytest.mark.parametrize(
    "text",
    [
        "P <5 kg and N > 40 kg", "pH < 6.5 and clay > 20 %", "(5_000 plants)", "stand_notes_v2.pdf", "$12 to $15 per tonne", "plots of 5 * 3 m", "(* p < 0.05, ** p < 0.01)", "10^3 cells",
        "row 3 == row 4", "C:\\plots\\north", "B&B and R&D partners", "see [3] and [7]", "the #1 choice", "(a -> b)", "set {n = 12}", "~ 30 days", "https://plots.example/a_b*c",
        "• one\n• two", "- one\n- two", "1. one\n2) two", "* one\n* two", "– winter –", "Title\n\nText follows here.", "it's the growers' own ''", "", "   ",
    ],
)
def test_signs_that_only_look_like_markup(text):
    assert found(text) == []
    assert clean(text) == text.strip()


@pytest.mark.parametrize(
    ("text", "language"),
    [
        ("<p>a <b>b</b></p>", "html"), ("a&nbsp;b", "html"), ("caf&eacute; b", "html"), ("&#8239;kg", "html"), ("&lt;p&gt;a&lt;/p&gt;", "html"), ("text <a href=\"https://x", "html"), ("x</P>y", "html"), ("<!-- pasted -->\nx", "html"),
        ("# Title\n\ntext", "markdown"), ("Title\n=====\n\ntext", "markdown"), ("a **b c** d", "markdown"), ("a ~~b~~", "markdown"), ("[a](https://x)", "markdown"), ("![a](b.png)", "markdown"), ("a `b` c", "markdown"), ("```\nx <- 1\n```", "markdown"), ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown"), ("> quoted", "markdown"), ("__a b__ c", "markdown"),
        ("== T ==\n\nx", "wiki"), ("a '''b''' c", "wiki"), ("a ''b'' c", "wiki"), ("a [[b|c]] d", "wiki"), ("{{note|x}}", "wiki"), ("[https://x y z]", "wiki"), ("{| class=\"g\"\n! h\n|-\n| 1\n|}", "wiki"), ("# One.\n# Two.", "wiki"),
        ("\\section{A}", "latex"), ("a \\emph{b} c", "latex"), ("$x_{1}^{2}$", "latex"), ("\\(Y = a\\)", "latex"), ("$$a^2$$", "latex"), ("a~\\cite{p}", "latex"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "latex"), ("{\\it a}", "latex"),
    ],
)
def test_each_construct(text, language):
    assert found(text) == [language]


def test_code_inside_markup_is_no_further_case():
    assert found("```\n<b>x</b> $a_1$ \\emph{y}\n```") == ["markdown"]
    assert found("<pre><code>plots &lt;- f('a')\n**x**</code></pre>") == ["html"]


def test_structure_is_kept():
    text = clean("<h2>Soil</h2><p>One<br/>two</p><ul><li>a<li>b</ul><table><tr><td>x</td><td>8</td></tr></table><pre><code>y &lt;- 1</code></pre>")
    assert text == "Soil\n\nOne\ntwo\n\n• a\n• b\n\nx | 8\n\n    y <- 1"
    assert clean("\\section{Soil}\n\nSee \\textbf{this}~\\cite{p}. \\[ a^2 \\]") == "Soil\n\nSee this. a^2"
    assert clean("== Soil ==\n\n{| class=\"g\"\n! kg\n|-\n| 28\n|}\n\n[[Category:X]]") == "Soil\n\nkg\n28"
    assert clean("&lt;p&gt;caf&amp;eacute;&lt;/p&gt;") == "café"


def test_simple_tree_matching():
    a, b = markup.Pattern.of(markup.parse("same\n\nown one\n\nfoot")), markup.parse("same\n\nother\n\nfoot")
    score, pairs = markup.match(a, b)
    leaves = [(x.before, y.words()) for x, y in pairs if y.kind == "text"]
    assert score == 2 and sorted(leaves) == [(["foot"], ["foot"]), (["same"], ["same"])]


def test_elements_hold_their_blocks():
    root = markup.parse("<div><p>a</p><ul><li>b<li>c</ul></div><p>d</p>")
    (passage,) = root.children
    assert [c.kind for c in passage.children] == ["div", "text"] and [c.kind for c in passage.children[0].children] == ["text", "ul"]
    assert [c.text for c in passage.children[0].children[1].children] == ["• b", "• c"]
    assert clean("</div><p>a</p><div><ul><li>b</div>c") == "a\n\n• b\n\nc"


def test_wrapper_of_pages():
    pages = [f"<div><p>Our platform for growers</p><p>Published on {d} May by the office</p></div><p>{c}</p><p>Imprint</p>" for d, c in ((1, "hay"), (2, "corn is ripe"), (17, "apples"), (4, "a cow"))]
    wrapper = markup.induce(pages)
    assert [(x.before, x.slot, x.after) for x in wrapper.leaves()] == [
        (["Our", "platform", "for", "growers"], False, []), (["Published", "on"], True, ["May", "by", "the", "office"]), (["Imprint"], False, []),
    ]
    left, slots = markup.content(markup.parse(pages[2]), wrapper)
    assert markup.write(left) == "17\n\napples" and slots == ["17"]
    alone = markup.parse("<p>Imprint</p>")
    assert markup.content(alone, wrapper)[0] is alone
    assert markup.induce(["<p>a</p>", "<p>b c</p>", "<p>d</p>", "<p>e</p>"]) is None
    assert markup.Pattern.from_list(wrapper.to_list()).to_list() == wrapper.to_list()


def test_templates_of_a_host_are_dropped(spark):
    rows = [(i, f"<p>Welcome to us</p><p>content {i}</p><p>Imprint</p>", "plain", f"https://h.example/{i}") for i in range(40)]
    rows += [(100, "<p>Welcome to us</p>", None, "https://other.example/1"), (101, None, "a &nbsp; b", None), (102, "", "", "no url"), (103, "<b>x</b> " * 4000, None, "https://h.example/x"), (101, None, "a &nbsp; b", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "rec_no long, description string, description_llm string, ko_content_url string, markup string")
    out = markup.clean(df).collect()
    got = {(r.rec_no, r.field_name): r for r in out}
    assert got[3, "description"].clean_text == "content 3" and list(got[3, "description"].markup) == ["html"]
    assert got[100, "description"].clean_text == "Welcome to us"
    assert got[102, "description"].clean_text == "" and list(got[102, "description"].markup) == []
    assert (101, "description") not in got and sum(1 for r in out if r.rec_no == 101) == 2
    joined = {(r.rec_no, r.field_name): r.clean_text for r in markup.clean(df, most_bytes=0).collect()}
    assert joined == {k: r.clean_text for k, r in got.items()}
    assert markup.clean(df.limit(0)).collect() == []
    marked = {(r.rec_no, r.field_name, r.markup) for r in markup.marked_up(df).collect()}
    assert (101, "description_llm", "html") in marked and not any(k[0] == 102 for k in marked)


def test_templates_are_learnt_from_all_pages(spark):
    """The pages that are first in the order of their hashes lack what 85 % of the host's pages share."""
    texts = [f"<p>page {i}</p><p>content {i * i}</p>" for i in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", "t", "t || '<p>Imprint of the farm office</p><p>Printed on day ' || i || ' by the farm office</p>' AS s")
    low = {r.i for r in df.selectExpr("i", "xxhash64(t) AS a").orderBy("a").limit(15).collect()}
    edge = max(r.a for r in df.selectExpr("i", "xxhash64(t) AS a").collect() if r.i in low)
    shared = [(r.i, r.s) for r in df.where(f"xxhash64(s) > {edge}").collect() if r.i not in low]
    rows = [(i, t, f"https://h.example/{i}") for i, t in [*shared, *((i, texts[i]) for i in low)]]
    pages = spark.createDataFrame(rows, "rec_no long, description string, ko_content_url string")
    assert len(shared) > 2 * len(low)
    got = {r.rec_no: r for r in markup.clean(pages, fields=("description",)).collect()}
    for i, _ in shared:
        assert "office" not in got[i].clean_text and got[i].slots == [str(i)] and f"content {i * i}" in got[i].clean_text
    parts = markup.learn_wrappers(pages, "rec_no", ("description",), "ko_content_url", group=10).collect()
    assert [r.w for r in parts] == [r.w for r in markup.learn_wrappers(pages, "rec_no", ("description",), "ko_content_url").collect()]


def test_special_and_general_leaves_of_a_wrapper():
    special, general = markup.Pattern("text", "Home of the farm office".split()), markup.Pattern("text", "Home of the".split(), ["office"], True)
    wrapper = markup.join([markup.Pattern("root", children=[markup.Pattern("passage", children=[x])]) for x in (special, general, special)])
    assert len(list(wrapper.leaves())) == 2
    for words, slots in (("farm", []), ("shop", ["shop"])):
        page = markup.parse(f"<p>Home of the {words} office</p><p>own</p>")
        assert markup.content(page, wrapper)[1] == slots and "own" in markup.write(markup.content(page, wrapper)[0])


def test_languages_of_a_template_count(spark):
    """A field whose only markup is what its host's pages share still has that language."""
    rows = [(i, f"content {i}\n\n<p>Welcome to us</p>", None, f"https://h.example/{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "rec_no long, description string, description_llm string, ko_content_url string")
    got = markup.clean(df).collect()
    assert len(got) == 40 and all(r.clean_text == f"content {r.rec_no}" and list(r.markup) == ["html"] for r in got)
    assert sorted(r.rec_no for r in markup.marked_up(df).collect()) == list(range(40))
