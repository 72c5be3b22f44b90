import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagecatalog.operators import extract as X, select as S
from pagecatalog.operators.elements import _Pages, elements


class Events(HTMLParser):
    """What the standard library makes of a page: tags, attributes, visible text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.text, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        seen = {}
        for name, value in attrs:
            seen.setdefault(name, value or "")
        self.tags.append((tag, list(seen.items())))
        self.hidden += tag in ("script", "style")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def flat(html):
    pages = _Pages()
    pages.add(html)
    ends = pages.attr_ends
    tags = [(t, list(zip(pages.attr_names[a:b], pages.attr_values[a:b])))
            for t, a, b in zip(pages.tag, ends, ends[1:])]
    return pages, tags


def agree(html):
    events = Events()
    events.feed(html)
    events.close()
    pages, tags = flat(html)
    assert tags == events.tags
    assert "".join(pages.texts[0]) == "".join(events.text)


def test_stored_pages_read_as_the_standard_library_reads_them(spark):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        agree(row.html)


@pytest.mark.parametrize("html", [
    "", "plain", "a < b > c", "<p>one<p>two", "<A HREF=x CLASS='a  b'>t</A>", "<img src=a.png alt>",
    "<a href='x' href='y'>", "<!-- <b>no</b> --><i>yes</i>", "<!DOCTYPE html><?x y?><b>z",
    "<script>if (a<b) '</p>'</script>after", "<title>a &lt;b&gt; c</title>", "<a title='&quot;x&amp;y'>&eacute;&#65;",
    "<div/>text</div>", "<a b=c/d e>", "<x-y z>", "</nothing>tail", "<a\nhref\n=\n'q'\n>w</a\n>",
])
def test_markup_forms(html):
    agree(html)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["<p>", "</p>", "<b>", "</b>", "<div class='a b'>", "</div>", "<br>", "text", " & ", "&amp;", "<ul>", "<li>",
     "</ul>", "<a href=\"/x?y=1&amp;z\">", "</a>", "<!-- c -->", "<img src='i'>", "é"]), max_size=30))
def test_generated_markup(pieces):
    html = "".join(pieces)
    agree(html)
    pages, _ = flat(html)
    for i, (last, start, length) in enumerate(zip(pages.last_ord, pages.text_from, pages.text_len)):
        assert i <= last < len(pages.tag)
        assert start + length <= len("".join(pages.texts[0]))
        # ranges nest
        assert all(pages.last_ord[j] <= last for j in range(i, last + 1))


@pytest.mark.parametrize("piece", ['<a b="', "<a <b \"", "<!-- ", "<a b='\"", "</", "<div>", "<p>", "&", "<p><table>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.perf_counter()
    flat(piece * 20_000)
    assert time.perf_counter() - began < 5


def test_unended_markup_ends_the_page():
    pages, tags = flat("<b>x</b>rest<a href='")
    assert [t for t, _ in tags] == ["b"] and "".join(pages.texts[0]) == "xrest"


PAGE = """<html><body class="Top"><div id=main class="card x"><a href="/1">one</a><span><a class="k" href="/2">two</a></span>
<a name=n>no href</a></div><a href="/DrugGroups/7">g</a><ul class="az-list"><li><a href=''>empty</a><li><b>bold
<li> <p>para<p>unclosed</ul><div class="nested"><div class="nested">inner<i>!</i></div></div></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    return elements(spark.createDataFrame([("u", PAGE), ("v", None), ("w", "")], "url string, html string")).cache()


@pytest.mark.parametrize("selector,want", [
    ("a", ["one", "two", "no href", "g", "empty"]),
    (".card a", ["one", "two", "no href"]),
    ("div.card.x span a.k", ["two"]),
    ("#main a[href]", ["one", "two"]),
    ('a[href*="/DrugGroups/"]', ["g"]),
    ('a[href="/2"]', ["two"]),
    ("ul.az-list li", ["empty", "bold", "paraunclosed"]),
    ("ul p", ["para", "unclosed"]),
    (".nested .nested", ["inner!"]),
    (".Top .nested i", ["!"]),
    (".absent a", None),
    ("a.absent", None),
    ("html A", ["one", "two", "no href", "g", "empty"]),
])
def test_selectors(page, selector, want):
    got = page.filter("url = 'u'").select(F.transform(S.matches(selector), S.text_of).alias("t")).first().t
    assert got == want


@pytest.mark.parametrize("selector", ["", "a > b", "a:first-child", "a, b", "*"])
def test_selectors_outside_the_grammar_are_refused(selector):
    with pytest.raises(ValueError):
        S.matches(selector)


def test_pages_without_html_give_no_document(page):
    assert sorted(r.url for r in page.select("url").collect()) == ["u", "w"]


def one(spark, html, column):
    return elements(spark.createDataFrame([("http://a/b/c", html)], "url string, html string")).select(column.alias("v")).first().v


@pytest.mark.parametrize("html,want", [
    ("<i class=b>B</i><i class=a> A \n</i><i class=a>A2</i>", "A"),
    ("<i class=b>B</i>", "B"),
    ("<i class=a> </i><i class=b>B</i>", ""),
    ("<i>none</i>", None),
])
def test_first_selector_that_matches_wins_even_with_empty_text(spark, html, want):
    assert one(spark, html, X.field_text(".a", ".b")) == want


@pytest.mark.parametrize("html,want", [
    ("<p class=x><img></p><p class=y><img src=2></p>", "2"),
    ("<p class=x><img><img src=1></p><p class=y><img src=2></p>", "2"),
    ("<p class=x><img src=''></p><p class=y><img src=2></p>", ""),
    ("<p class=x><img src=1></p>", "1"),
    ("<p>no image", None),
])
def test_attribute_of_first_match(spark, html, want):
    assert one(spark, html, X.field_attribute("src", ".x img", ".y img")) == want


@pytest.mark.parametrize("html,want", [
    ("<ul class=s><li>a<li> b </ul><p class=t>no", ["a", "b"]),
    ("<p class=s> whole <b>text</b>", ["whole text"]),
    ("<p class=s></p><p class=t>later", [""]),
    ("<p class=t>later", ["later"]),
    ("<p>none", []),
])
def test_list_field(spark, html, want):
    assert one(spark, html, X.field_list(".s", ".t")) == want


@pytest.mark.parametrize("html,want", [
    ("<dl><dt>Size<dd>1<dt>Manufacturer:<dd> M <b>&amp; Co</b></dl>", "M & Co"),
    ("<dl><dt>The Manufacturer</dt><dt>x</dt><dd>late</dd></dl>", "late"),
    ("<dl><dt>manufacturer<dd>case</dl>", "Unknown"),
    ("<dl><dt>Manufacturer</dl>", "Unknown"),
    ("", "Unknown"),
])
def test_label_value(spark, html, want):
    assert one(spark, html, X.field_after_label("dt", "Manufacturer", "dd")) == want


def fields(spark, html, **columns):
    docs = elements(spark.createDataFrame([("u", html)], "url string, html string"))
    return docs.select(*[c.alias(n) for n, c in columns.items()]).first()


def test_elements_of_any_depth_are_opened(spark):
    row = fields(spark, "<div>" * 600 + "<h1>Deep</h1>" + "</div>" * 600, title=X.field_text("h1"))
    assert row.title == "Deep"
    nested = "<div class=outer>" + "<div>" * 520 + "x" + "</div>" * 520 + "<b>tail</b></div><b>after</b>"
    row = fields(spark, nested, inner=X.field_text(".outer b"), n=F.size(S.matches(".outer div")), b=F.size(S.matches(".outer b")))
    assert (row.inner, row.n, row.b) == ("tail", 520, 1)
    began = time.perf_counter()
    flat("<div><p>" * 100_000 + "</div>" * 100_000)
    assert time.perf_counter() - began < 10


def test_descendants_of_nested_scopes(spark):
    html = "<ul class=a><li>1<ul class=a><li>2</li></ul></li></ul><li>3</li>" + "<ul><li>4</li></ul>" * 300 + "<ul class=a><li>5</li></ul>"
    row = fields(spark, html, one=F.transform(S.matches(".a li"), lambda e: S.text_of(e)), two=F.size(S.matches("ul ul li")),
                 every=F.size(S.matches("ul li")), none=F.size(S.matches("li .a .a")))
    assert row.one == ["12", "2", "5"] and (row.two, row.every, row.none) == (1, 303, 0)


def test_text_across_pieces(spark):
    html = "<p>" + "é" * 1020 + "</p><p>" + "b" * 5000 + "</p><p></p><p> tail </p>"
    row = fields(spark, html, texts=F.transform(S.matches("p"), lambda e: S.text_of(e)))
    assert row.texts == ["é" * 1020, "b" * 5000, "", "tail"]


def test_long_pages_take_linear_time(spark):
    blanks = "<h1>a" + " " * 100_000 + "b" + " " * 100_000 + "</h1>"
    items = "<nav><ul>" + "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(50_000)) + "</ul></nav>"
    pages = elements(spark.createDataFrame([(blanks,), (items,)], "html string"), keep=()).persist()
    pages.count()
    fields_of = [X.field_text("h1"), F.size(S.matches("nav ul li a")), F.size(X.field_list("nav"))]
    pages.filter("false").select(*[F.max(c) for c in fields_of]).collect()
    for column, want in zip(fields_of, ("a" + " " * 100_000 + "b", 50_000, 50_000)):
        began = time.perf_counter()
        assert pages.agg(F.max(column)).first()[0] == want
        assert time.perf_counter() - began < 8  # quadratic: minutes
    pages.unpersist()


def test_elements_that_no_selector_names_stay_behind_and_the_others_are_found_alike(spark):
    captures = spark.createDataFrame([("u", PAGE)], "url string, html string")
    whole = elements(captures)
    for selectors in (("a",), (".card a", "ul.az-list li"), ("div.card.x span a.k", "i"), (".nested .nested",), (".absent", "#main a[href]")):
        only = S.names_of(*selectors)
        reduced = elements(captures, only=only)
        found = [S.matches(s) for s in selectors] + [S.first_matching(selectors)]
        texts = [F.transform(f, S.text_of).alias(f"t{i}") for i, f in enumerate(found)]
        attrs = [F.transform(f, lambda e: F.map_entries(e["attrs"])).alias(f"a{i}") for i, f in enumerate(found)]
        assert reduced.select(*texts, *attrs).collect() == whole.select(*texts, *attrs).collect()
        kept, every = (d.select(F.size("elements").alias("n")).first().n for d in (reduced, whole))
        assert kept < every
    assert S.names_of("a", "[href]") is None  # any element may have the attribute


def test_record_and_child_fields_need_the_named_elements_alone(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").limit(200).collect()
    rows += [("r", '<p>x<h1> T &amp; </h1><b class=EnglishTopLabel></b><i class="company"> M\n</i><div class=image><p>y<img src="/i.png"></div>'
              '<ul class="composition z">a<li>one<li> two <b>deep</b></ul><div class="text-xs-center"><a class=ahref_Generic href=/c/1>q</a>'
              '<a class=ahref_Generic>no</a><span><a class="ahref_Generic" href="p/3">w</a></span><a class=ahref_Generic href=/c/1>q</a></div>'
              '<a class=ahref_Generic href=/out>o</a>'),
             ("s", '<div class="text-xs-center"><div class="text-xs-center"><a class=ahref_Generic href=a></a></div></div>'
              '<div class="text-xs-center"><a class=ahref_Generic href=/b></a></div><div class="formula">one text</div>'),
             ("c", '<h1 id="h1PersianName">P</h1><h2 id="h2EnglishName">E</h2><a class="ahref_GenericWhiteColor x">7</a>')]
    captures = spark.createDataFrame(rows, "url string, html string")
    for names, fields in ((X.RECORD_NAMES, lambda d: X.record_fields(d, "https://a.example")), (X.CHILD_NAMES, X.child_fields)):
        got = {r.url: r for r in fields(elements(captures, only=names)).collect()}
        assert got == {r.url: r for r in fields(elements(captures)).collect()} and len(got) == len({r[0] for r in rows})
        if "combinations" in got["r"]:
            assert got["r"].combinations == ["one", "two deep"] and got["r"].child_urls == ["https://a.example/c/1", "https://a.example/p/3"]
            assert got["s"].child_urls == ["https://a.example/a", "https://a.example/b"] and got["s"].combinations == ["one text"]
            assert (got["r"].manufacturer, got["r"].image_src, got["r"].english_name, got["r"].persian_name) == ("M", "/i.png", "", "T &")


def test_fields_by_a_name_take_no_lambda(spark):
    docs = elements(spark.createDataFrame([("u", PAGE)], "url string, html string"))
    plan = docs.select(X.field_text(".card", "h1"), X.field_attribute("src", ".k", "#main")) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
