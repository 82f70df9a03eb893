"""Page elements that once lost class words or text."""

from html.parser import HTMLParser

from tracewright.llm import html_text


def test_all_class_words():
    page = "<div class='col-md-4 col-sm-12 px-3 py-2 bg-light sidebar'><p>x</p></div>"
    assert "C:sidebar" in html_text.blocks_of(page)[0].path


def texts(page):
    return [b.text for b in html_text.blocks_of(page)]


def test_only_raw_text_is_dropped():
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == ["so x=2 holds"]
    assert texts("<article><noscript><p>no script</p></noscript><object>film</object><canvas>chart</canvas>") == ["no script", "film", "chart"]
    assert texts("<p>a<svg><path d=''>b<p>c<iframe>d<p>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>one<object>two</object>three") == ["one", "two", "three"]


def test_ends_on_turkish_pages():
    assert texts("<p>İİİİ</p><script>var a;</SCRIPT><p>after") == ["İ" * 4, "after"]
    assert texts("<p>İİ</p><style>p{}</style >x<script>'</scripted>'</script>y") == ["İİ", "x", "y"]


def test_quotes_count_after_an_equals_sign_only():
    assert texts("<article><p title=don't>one</p><p class=a'b data-x=\"c>d\">two</p><p it's>three</p></article>") == ["one", "two", "three"]
    assert html_text.blocks_of("<div title=' class=sidebar ' class = 'post entry'><p>x")[0].path[:3] == ("T:div", "C:post", "C:entry")


class Slow(HTMLParser):
    """A second reading of pages by the standard library: text between block tags, but that of some elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.raw = [], [], 0

    def flush(self):
        if text := " ".join("".join(self.held).split()):
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "textarea"):
            self.raw += 1
        if tag == "br":
            self.held.append(" ")
        elif tag not in html_text.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "textarea"):
            self.raw = max(0, self.raw - 1)
        if tag not in html_text.INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.raw:
            self.held.append(data)


def test_blocks_against_the_standard_library():
    pages = [html_text._Writer(seed).page() for seed in range(200)]
    pages += ["<article><h1>İstanbul</h1><p title=don't>İİ <math><mi>x</mi></math></p><noscript>n</noscript><object>o</object></article><footer>f"]
    for page in pages:
        slow = Slow()
        slow.feed(page)
        slow.close()
        slow.flush()
        assert texts(page) == slow.out


#: Pages marked by hand: what is the main text of each.
MARKED = [
    (
        "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul></nav><article><h1>On İznik tiles</h1>"
        "<p title=don't>The workshop painted its tiles in cobalt blue, and later in red, for more than a century.</p>"
        "<p>Where <math><mi>x</mi></math> tiles broke, <object>a drawing</object> shows the pattern that was lost to the fire.</p></article>"
        "<footer>&copy; 2020 Example</footer></body></html>",
        ["On İznik tiles", "The workshop painted its tiles in cobalt blue, and later in red, for more than a century.", "Where x tiles broke,", "a drawing", "shows the pattern that was lost to the fire."],
    ),
    (
        "<html><body><header><h2>Daily News</h2></header><div class='sidebar'><h3>Related</h3><ul><li><a href='/1'>One</a></li></ul></div>"
        "<article><h1>A quiet harbour</h1><p>Boats came in at noon, and the market opened late because of the rain.</p><script>var p = '<p>no</p>';</script>"
        "<p>By evening the quay was empty again, and the lamps were lit along the wall.</p></article>"
        "<section class='comments'><h3>Comments</h3><div class='comment'><p>First!</p></div></section><form><label>Search</label><input><button>Go</button></form></body></html>",
        ["A quiet harbour", "Boats came in at noon, and the market opened late because of the rain.", "By evening the quay was empty again, and the lamps were lit along the wall."],
    ),
]


def test_pages_marked_by_hand():
    model = html_text.trained()
    for page, want in MARKED:
        assert html_text.main_text(page, model).split("\n\n") == want
