"""Site templates, chat repair, language identification, toxicity and the pipeline."""

import itertools
import random
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from marketml.llm import chat_repair, decontaminate, language_id, packing, perplexity, queries, site_templates, toxicity
from tests.llm.test_simhash import plain_components
from tests.llm.test_text_operators import _plain_contamination, _plain_spans

PAGES = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("host", T.StringType()), ("few", T.LongType()))])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


# -- site templates --------------------------------------------------------------

@pytest.mark.parametrize(("source", "text"), [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two <b>bold</b>er<br>line", "one\ntwo bolder line"),
    ("<nav>menu</nav><article><h1>Head</h1><p>A &amp; B&nbsp;C &lt;x&gt;</p></article><footer>f</footer>", "Head\nA & B C <x>"),
    ("<body><header>site</header><main><header><h1>T</h1></header><p>x</p><aside>s</aside></main>", "T\nx"),
    ("<article>a<div class='ad'>buy</div><section class=comments><p>rant</p></section><div hidden>h</div>z</article>", "a\nz"),
    ("<script>var t='</p><p>no';</script><style>p{}</style><p title='a>b'>yes</p><!-- <p>no</p> -->", "yes"),
    ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", "one\ntwo\nc1\nc2"),
    ("<p>cut <b", "cut"), ("<p>cut &am", "cut &am"), ("a<script>never ends", "a"), ("</p></div>stray<x-y>odd</x-y>", "strayodd"),
    ("<div " + "a='" * 50 + ">x", "x"),
    ("<div class='container has-sidebar'><p>A page of one article.</p><div class='sidebar'><p>Other things to see here.</p></div><p>It ends with this line.</p></div>", "A page of one article.\nIt ends with this line."),
    ("<article><div class='entry no-comments'><p>All of the text is here.</p></div></article>", "All of the text is here."),
    ("<p id='search-for-meaning'>A chapter about the search.</p>", "A chapter about the search."),
    ("<div class='site-nav'>a b</div><div class='widget'><p>The whole of a page in a widget.</p></div>", "The whole of a page in a widget."),
    ("<p>A short post of seven words here.</p><div id=comments>" + "".join(f"<div class=comment><p>Reader {i} has this and more to say about it.</p></div>" for i in range(9)) + "</div>", "A short post of seven words here."),
    ("<form id=aspnet><p>The text of a page inside a form.</p><input><button>Send</button></form>", "The text of a page inside a form."),
    ("<p>The text of a page with a form.</p><form><label>Your name</label></form>", "The text of a page with a form."),
])
def test_main_text(source, text):
    assert site_templates.main_text(source) == text


def test_deep_and_long_markup():
    assert site_templates.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    long = "word " * 200_000
    assert site_templates.main_text(f"<p>{long}") == long.strip()


def test_templates_go_and_copies_stay(spark):
    box = '<div id="x1"><p>Follow us everywhere today</p></div>'
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<div><p>Story {i} begins.</p><p>It goes on {i}.</p></div></body>") for i in range(20)]
    rows += [(100 + i, f"http://A.example/copy/{i}", f"<body>{box}<div><p>The same story.</p><p>Shown at several addresses.</p></div></body>") for i in range(5)]
    rows += [(200, "http://b.example/", f"<body>{box}<p>Other</p></body>"), (201, None, None), (202, "", ""), (0, "http://a.example/0", rows[0][2])]
    got = Counter((r.page_id, r.text) for r in site_templates.extract(pages(spark, rows)).collect())
    want = Counter((i, f"Story {i} begins.\nIt goes on {i}.") for i in range(20))
    want.update([(100 + i, "The same story.\nShown at several addresses.") for i in range(5)])
    want.update([(200, "Follow us everywhere today\nOther"), (201, ""), (202, ""), (0, "Story 0 begins.\nIt goes on 0.")])
    assert got == want
    assert site_templates.extract(pages(spark, [])).count() == 0


def _three_parts(n, extra=""):
    return f"<body>{extra}<section><p>Part one of story {n} tells how it began.</p></section><div><p>Part two of story {n} tells how it went.</p></div><ul><li>Part three of story {n} tells how it ended.</ul></body>"


def _three_texts(n):
    return "\n".join(f"Part {k} of story {n} tells how it {v}." for k, v in (("one", "began"), ("two", "went"), ("three", "ended")))


def test_articles_of_several_parts_stay(spark):
    # Exact copies at 3 addresses; copies with a date of their own; a host mostly of copies.
    rows = [(i, f"http://c.example/{i}", _three_parts(min(i, 97))) for i in range(100)]
    rows += [(200 + i, f"http://c.example/dated/{i}", _three_parts("dated", f"<p>Seen on day {i}.</p>")) for i in range(4)]
    rows += [(300 + i, f"http://d.example/{i}", _three_parts("copied") if i < 10 else f"<p>Other {i}</p>") for i in range(14)]
    rows += [(400 + i, f"http://e.example/{i}", _three_parts("daily", f"<p>Day {i}.</p>")) for i in range(10)]
    got = {r.page_id: r.text for r in site_templates.extract(pages(spark, rows)).collect()}
    want = {i: _three_texts(min(i, 97)) for i in range(100)}
    want |= {200 + i: f"Seen on day {i}.\n" + _three_texts("dated") for i in range(4)}
    want |= {300 + i: _three_texts("copied") if i < 10 else f"Other {i}" for i in range(14)}
    want |= {400 + i: f"Day {i}.\n" + _three_texts("daily") for i in range(10)}
    assert got == want


def test_templates_of_a_few_pages_of_a_large_host(spark):
    # A box on 9 pages, a notice on 10, and a heading and a short line on 30 of 1,000.
    box, notice = '<div id="x1"><p>Our offer ends this week only</p></div>', "<p>This text was first shown last year.</p>"
    def page(i):
        return f"<body>{box * (i < 9)}{notice * (i < 10)}<h2>{'Contents' if i < 30 else i}</h2><p>Story {i} begins with many words of its own, and goes on {i}.</p><p>{'He nodded.' if i < 30 else i}</p></body>"
    rows = [(i, f"http://big.example/{i}", page(i)) for i in range(1000)]
    got = {r.page_id: r.text for r in site_templates.extract(pages(spark, rows)).collect()}
    assert got == {i: f"{'Contents' if i < 30 else i}\nStory {i} begins with many words of its own, and goes on {i}.\n{'He nodded.' if i < 30 else i}" for i in range(1000)}


def test_a_box_longer_than_the_articles(spark):
    box = '<div id="x1"><p>' + "About this site and all of its many friends. " * 9 + "</p></div>"
    aside = '<div id="x2"><ul><li>Here we list the friends of our site<li>And some more friends of our site</ul></div>'
    rows = [(i, f"http://f.example/{i}", f"<body>{box}<div><p>Article {i} is short, with only a few words of its own.</p></div>{aside}</body>") for i in range(5)]
    got = {r.page_id: r.text for r in site_templates.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Article {i} is short, with only a few words of its own." for i in range(5)}


class _Article(HTMLParser):
    """The article's blocks, read by the standard library."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [""]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.lines += [""] if tag in ("p", "h1", "article") else []
        self.lines[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.lines += [""] if tag in ("p", "h1", "article") else []

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data

    def text(self):
        return "\n".join(line for line in (" ".join(raw.split()) for raw in self.lines) if line)


def _plain_extract(rows, few=3, many=8, half=0.5, own_words=6):
    """Templates by counting in dictionaries; rows are (host, html)."""
    parsed = [(host, site_templates.Page(html or "").row()) for host, html in rows]
    pages_of = {}
    for host, row in parsed:
        pages_of.setdefault(host, {})[row["page"]] = row
    chosen = {}
    for host, each in pages_of.items():
        parts = {page: {(d, site_templates.BOX) for d in r["boxes"]} | set(zip(r["marks"], r["kinds"], strict=True)) for page, r in each.items()}
        shared = {part for part, n in Counter(x for s in parts.values() for x in s).items() if n >= few}
        own = {}
        for page, r in each.items():
            mine = {(m, k): n for m, k, n in zip(r["marks"], r["kinds"], r["words"], strict=True) if (m, k) not in shared}
            if sum(mine.values()) >= own_words:
                own[page] = frozenset(mine)
        for part in shared:
            n = len({own[page] for page, s in parts.items() if part in s and page in own})
            least = {site_templates.BOX: few, site_templates.PARAGRAPH: many, site_templates.TEXT: max(many, half * len(set(own.values())))}
            if n >= least.get(part[1], float("inf")):
                chosen.setdefault(host, set()).add(part[0])
    return [site_templates.kept_text(r["texts"], r["marks"], r["boxes"], r["firsts"], r["ends"], chosen.get(host, set())) for host, r in parsed]


def test_extract_equals_plain_version(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = [tuple(r) for r in table.select("page_id", "url", "html").collect()]
    got = {r.page_id: r.text for r in site_templates.extract(table).collect()}
    assert got == {i: _Article(html).text() for i, _, html in given}
    # Random pages of parts that recur at random.
    rng = random.Random(5)
    stock = [f"<div><p>Box {k} of the site says a few words.</p></div>" for k in range(6)] + [f"<p>Notice {k} is shown on many pages.</p>" for k in range(6)] + ["<h2>Contents</h2>", "<ul><li>one item of a list<li>two</ul>", "<p>short</p>"]
    rows = []
    for i in range(150):
        own = [f"<p>Own text {rng.randrange(60)} with more words than a date has.</p>" for _ in range(rng.randrange(3))]
        body = own + rng.sample(stock, rng.randrange(6))
        rng.shuffle(body)
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<body>{''.join(body)}</body>"))
    rows += [(1000 + i, "http://h0.example/copy", rows[0][2]) for i in range(40)]
    got = {r.page_id: r.text for r in site_templates.extract(pages(spark, rows)).collect()}
    want = _plain_extract([(url.split("/")[2], html) for _, url, html in rows])
    assert got == {i: text for (i, _, _), text in zip(rows, want, strict=True)} and len(set(want)) > 40


# -- chat repair -----------------------------------------------------------------

ALL = [(r, e) for r in (None, 1, 2, 3) for e in (False, True)]


def _legal(roles):
    state = 0
    for r in roles:
        if r not in chat_repair.NEXT[state]:
            return False
        state = r
    return state == chat_repair.ASSISTANT


def _cheapest(kinds):
    """Over every choice of keep, relabel, merge and insertions, by trying all."""
    best = float("inf")
    inserts = [(), (1,), (2,), (3,), (1, 2), (2, 3), (3, 2), (1, 2, 3)]
    todo = [((), 0, 0)]
    while todo:
        roles, i, cost = todo.pop()
        if cost >= best:
            continue
        if i == len(kinds):
            for tail in inserts:
                if _legal(roles + tail):
                    best = min(best, cost + 2 * len(tail))
            continue
        role, empty = kinds[i]
        if roles and (role in (None, roles[-1]) or empty):
            todo.append((roles, i + 1, cost + (1 if role is not None else 2)))
        for path, x in itertools.product(inserts, (1, 2, 3)):
            new, state = (*roles, *path, x), 0
            if all(r in chat_repair.NEXT[s] for s, r in zip((0, *new), new, strict=False)):
                todo.append((new, i + 1, cost + 2 * len(path) + (0 if x == role else 1 if role is None else 3)))
    return best


def _result(steps):
    roles = []
    for _, after, action, inserted in steps:
        roles += [*inserted, after] if action != "merge" else []
    return [*roles, *chat_repair.CLOSE[steps[-1][1]]]


def test_repair_is_cheapest_and_legal():
    rng = random.Random(1)
    for n in (1, 2, 3):
        for kinds in itertools.islice(itertools.product(ALL, repeat=n), 0, None, 1 if n < 3 else 7):
            steps, cost = chat_repair.repair(list(kinds))
            assert cost == _cheapest(kinds) and _legal(_result(steps))
    for _ in range(20):
        kinds = [rng.choice(ALL) for _ in range(5)]
        steps, cost = chat_repair.repair(kinds)
        assert cost == _cheapest(kinds) and _legal(_result(steps))


CHAT = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("seg", T.StringType()), ("place", T.DoubleType()))])


@pytest.mark.parametrize("segment_rows", [20_000, 15])
def test_segments_give_the_same_conversation(spark, segment_rows):
    rng = random.Random(2)
    names = ["user", "assistant", "system", "Human", "gpt", "tool", None, ""]
    rows = [(c, t, rng.choice(names), rng.choice(["hi", "", None, "text <|user|>"])) for c in range(25) for t in range(rng.randrange(1, 6))]
    rows += [(99, t, rng.choice(names), "long") for t in range(200)]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (3, 1, "user", "hi"), (3, 1, "user", "hi")]
    out = chat_repair.repair_roles(spark.createDataFrame([(*r, "clash", 1.0) for r in rows], CHAT), segment_rows).collect()
    assert len(out) == len(rows)
    low = lambda x: (x is not None, x)
    text_of = lambda x: (x is not None, x or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), text_of(r[2]), text_of(r[3])))
        steps, cost = chat_repair.repair([chat_repair.kind(r[2], r[3]) for r in mine])
        got = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.place)
        roles, spent = [], 0
        for r in got:
            if r.action != "merge":
                roles += [*r.inserted_before, r.new_role]
            role, _ = chat_repair.kind(r.role, None)
            spent += 2 * len(r.inserted_before) + {"keep": 0, "merge": 1 if role is not None else 2, "relabel": 3 if role is not None else 1}[r.action]
        roles += got[-1].inserted_after
        spent += 2 * len(got[-1].inserted_after)
        assert spent == cost and _legal([{v: k for k, v in chat_repair.ROLES.items()}[r] for r in roles])
        whole = "".join(r.rendered for r in got)
        assert [p.split("|>")[0] for p in whole.split("<|")[1::2]] == roles and whole.count("<|end|>\n") == len(roles)


def test_products_of_products(spark):
    """Three levels of matrices give the cost of one plain run over a conversation, null ids included."""
    rng = random.Random(4)
    names = ["user", "assistant", "system", "gpt", "tool", None]
    convs = {c: [(t, rng.choice(names), rng.choice(["hi", "", "x" * 300_000])) for t in range(90)] for c in (None, 7)}
    rows = [(c, *r) for c, turns in convs.items() for r in turns]
    out = chat_repair.repair_roles(spark.createDataFrame([(*r, "clash", 1.0) for r in rows], CHAT), 6, fan=4).collect()
    for conv, turns in convs.items():
        _, cost = chat_repair.repair([chat_repair.kind(r, x) for _, r, x in turns])
        got = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.place)
        assert [(r.turn, r.role) for r in got] == [(t, r) for t, r, _ in turns]
        spent = 0
        for r in got:
            spent += 2 * (len(r.inserted_before) + len(r.inserted_after))
            spent += {"keep": 0, "merge": 1 if chat_repair.kind(r.role, None)[0] is not None else 2, "relabel": 3 if chat_repair.kind(r.role, None)[0] is not None else 1}[r.action]
        assert spent == cost


def test_equal_rows_spread_over_segments(spark):
    rows = [(None, None, "user", "")] * 300 + [(c, t, r, "x") for c in range(30) for t, r in enumerate(("user", "assistant"))]
    out = chat_repair.repair_roles(spark.createDataFrame([(*r, "clash", 1.0) for r in rows], CHAT), 20).collect()
    assert len(out) == len(rows) and max(Counter(r.place >> 40 for r in out).values()) <= 60
    mine = sorted((r for r in out if r.conv_id is None), key=lambda r: r.place)
    assert [r.action for r in mine] == ["keep"] + ["merge"] * 299
    assert "".join(r.rendered for r in mine) == "<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"


def test_no_conversations(spark):
    assert chat_repair.repair_roles(spark.createDataFrame([], CHAT)).count() == 0


# -- language identification -----------------------------------------------------

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
WORDS = {"en": "the this that with from house walking there", "de": "der die das und nicht schön heißt wohnung", "fr": "le la les une êtes français où maison"}


def _speak(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_languages(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, _speak(rng, lang, 40), lang, "s", 1) for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(900, None, "en", "s", 1), (901, "x", None, "s", 1)], DOCS)
    rows = [(i, f"http://www.{lang}.example.{'de' if lang == 'de' else 'com'}/{i}", f'<html lang="{lang}-XX"><script>the the</script><p>{_speak(rng, lang, 30)}</p>') for i, lang in enumerate(["en", "de", "fr"] * 12)]
    # Little text: the other evidence decides; a wrong declaration does not beat the text.
    rows += [(500, "http://www.de.example.de/x", "<html><p>1</p>"), (501, "http://new.test/", '<html lang="de"><p>12</p>'), (502, "http://www.en.example.com/y", f'<html lang="fr"><p>{_speak(rng, "en", 60)}</p>'), (503, None, None), (0, rows[0][1], rows[0][2])]
    got = {r.page_id: r for r in language_id.identify(pages(spark, rows), docs).collect()}
    assert len(got) == len(rows) - 1 and all(got[i].lang == ("en", "de", "fr")[i % 3] for i in range(36))
    assert got[500].lang == "de" and got[501].lang == "de" and got[502].lang == "en" and got[502].declared == "fr"
    assert got[503].lang is not None and got[503].host == "" and 0 < got[503].confidence < 0.9
    assert language_id.identify(pages(spark, []), docs).count() == 0
    none = language_id.identify(pages(spark, rows), docs.where("false")).collect()
    assert len(none) == len(rows) and all(r.lang is None for r in none)
    with pytest.raises(ValueError, match="languages"):
        language_id.train_text_model(docs, max_languages=2)


def test_declared_and_visible():
    assert language_id.declared("<!-- <html lang=xx> --><HTML class=a LANG='pt-BR'>") == "pt"
    assert language_id.declared('<meta http-equiv="Content-Language" content="it">') == "it"
    assert language_id.declared("<html lang=english>") is None
    assert language_id.visible("a<style>b</style>&eacute;<i>c") == "a  é c".replace("  ", " ")


# -- toxicity --------------------------------------------------------------------

LABELS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("quality", T.IntegerType()), ("toxic", T.IntegerType()), ("text", T.StringType()))])


def _toxic_rows(n):
    rng = random.Random(5)
    sound = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        parts = [" ".join(sound() for _ in range(8)) for _ in range(6)]
        if i % 6 == 0:
            for k in rng.sample(range(6), 2):
                parts[k] += rng.choice([" vileword", " grimstemka", " grimstemlo"])
        rows.append((i, ". ".join(parts)))
    return rows


def test_toxicity_held_out_and_located(spark):
    rows = _toxic_rows(600)
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in [*rows, (9000, None), (9001, ""), (None, rows[0][1])]], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0), "clash") for i in range(400)] + [(500, 1, None, "x"), (None, 1, 1, "x")], LABELS)
    model = toxicity.train(docs, labels)
    out = {(r.doc_id, r.text): r.toxicity for r in toxicity.score(docs, model).collect()}
    assert out[9000, None].score == out[9001, ""].score == 0
    right = sum((out[r].score >= 0.7) == (r[0] % 6 == 0) for r in rows[400:])
    assert right >= 196
    assert out[None, rows[0][1]] == out[rows[0]]
    for r in rows[400:]:
        bad = {k for k, s in enumerate(r[1].split(". ")) if "vile" in s or "grim" in s}
        if out[r].score >= 0.7:
            assert {x.sentence for x in out[r].worst} <= bad
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert one.idle and {r.toxicity.score for r in toxicity.score(docs, one).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_noisy_or():
    assert abs(toxicity.noisy_or(np.array([0.5, 0.5])) - 0.75) < 1e-12 and toxicity.noisy_or(np.zeros(0)) == 0


# -- pipeline --------------------------------------------------------------------

def _corpus():
    rng = random.Random(6)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "ra", "se") for b in ("ban", "den", "fil", "gor", "hum", "")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = say(30)
    rows = [(i, say(rng.randrange(60, 300)), "en", "s0", 1) for i in range(80)]
    rows += [(200 + i, rows[i][1], "en", "s1", 1) for i in range(10)]
    rows += [(300, rows[3][1] + " extra", "en", "s1", 1), (301, say(60) + " " + item + " " + say(60), "en", "s1", 1), (302, say(400) + " token = abcdef0123456789 " + say(20), "en", "s1", 1), (303, "short", "en", "s1", 1), (304, None, None, None, None), (5, rows[5][1], "en", "s0", 1)]
    return rows, item


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, item = _corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    bench = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    spark.createDataFrame([(1, item)], bench).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    judged = {(r.keep_doc_id, r.keep_text): r.kept for r in perplexity.judge(docs, keep=("doc_id", "text")).collect()}
    # Each stage's input is worked out here from the stage before it.
    stage = [(r[0], r[1]) for r in rows if judged[r[0], r[1]]]
    assert {303, 304}.isdisjoint({d for d, _ in stage}) and len(stage) >= 90
    ids = {c for *_, c in plain_components(stage)}
    stage = list({d: t for d, t in stage if d in ids}.items())
    assert {200, 300}.isdisjoint(d for d, _ in stage)
    stage = [r for r, w in zip(sorted(stage, key=str), _plain_contamination(stage, [(1, item)]), strict=True) if not w[5]]
    assert 301 not in {d for d, _ in stage}
    encode = packing.Encoder(queries.tokenizer_path())
    for d, t in stage:
        for s, k, e in reversed(_plain_spans(t)):
            t = t[:s] + f"[{('assign', 'access', 'hex')[k]}]" + t[e:]
        kept.append((d, len(encode([t])[0]) // 4 + 1))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({(r.doc_id, r.doc_tokens) for r in got}) == sorted(kept)
    assert sum(r.length for r in got) == sum(n for _, n in kept)
    for (name, f), columns in zip(corpus_pipeline.STAGES, [docs.columns] * 4 + [None], strict=True):
        empty = f(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0 and columns in (None, empty.columns), name
    assert decontaminate.WINDOW == 13


def test_a_dirty_language_column_raises_before_counting(spark):
    dirty = spark.createDataFrame([(f"text {i}", f"lang{i}") for i in range(10_000)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 512 languages"):
        language_id.train_text_model(dirty)


def test_pages_are_not_shuffled_by_declaration_or_suffix(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    plan = language_id.identify(table, docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(declared" not in plan and "hashpartitioning(suffix" not in plan
