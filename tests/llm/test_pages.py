"""Main text of pages, and chat templates."""

import hashlib
import random
import time

import pytest

from quillspark.llm import chat, html_extract


def text_of(page):
    return html_extract.extract(page, html_extract.learned_weights())


def test_best_region_is_that_of_all_regions():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 14))]
        begin, end = html_extract.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)
        assert sum(scores[begin:end]) == max(0.0, best) and (end > begin) == (best > 0)


@pytest.mark.parametrize(("page", "want"), [
    ("<title>T</title><meta charset=utf8><p>One two three four five.<p>Six seven eight.", "One two three four five. Six seven eight."),
    ("<head><title>T</title><h1>Head line here</h1><p>One two three four five.</p>", "Head line here One two three four five."),
    ("<html><head>Words right here and more of them<p>yes yes yes yes", "Words right here and more of them yes yes yes yes"),
    ("<head><noscript><img></noscript><title>T</title></head><body><p>One two three four.</p></body>", "One two three four."),
    ("<article><p>One two three four.<svg class='i'/></p><p>Five six seven.<iframe src='x'/> eight</p></article>", "One two three four. Five six seven. eight"),
    ("<div><button>a</div><article><p>one two three four five</p></article><button>b</button>", "one two three four five"),
    ("<body>" + "<div>" * 30 + "<p>One two three four five.</p><p>Six seven</p>" + "</div>" * 30 + "<footer>x y z</footer>", "One two three four five. Six seven"),
])
def test_pages_without_loss(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("mark", ["<i>a ", "<div>a ", "<li>a ", "<b><p>x", "<svg>", "<p>x</q>"])
def test_time_is_linear_in_unclosed_tags(mark):
    began = time.perf_counter()
    text_of("<body>" + mark * 200_000)
    assert time.perf_counter() - began < 20  # a walk through the stack for each tag would take hours


def test_extract_pages(spark):
    rows = [(1, "u", "<article><p>a b c d</p></article>", "clash", 5), (1, "u", "<article><p>a b c d</p></article>", "clash", 5), (None, None, None, None, 5), (2, "v", "", "x", 5), (3, "w", "<p>" + "word " * 300_000, "x", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["text"][:7], r["n_chars"]) for r in html_extract.extract_pages(frame).collect()), key=str)
    assert got == sorted([(1, "u", "a b c d", 7), (1, "u", "a b c d", 7), (None, None, "", 0), (2, "v", "", 0), (3, "w", "word wo", 1_499_999)], key=str)
    assert html_extract.extract_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("source", "want"), [
    ("{{ 12 | length }}", "2"), ("{{ none | upper }}", ""), ("{{ true ~ 1 }}", "True1"), ("{% if 'b' | upper == 'B' %}y{% endif %}", "y"),
    ("a {%- if true %} b {%- endif -%} c", "a bc"), ("a {{- 'x' -}} b", "axb"), ("a {#- note -#} b", "ab"), ("{% if false %}{{ 1 < 'a' }}{% endif %}z", "z"),
    ("{% for m in messages %}{{ m.t }}{% if not loop.last %}, {% endif %}{% endfor %}", "p, q"),
])
def test_folding_changes_no_result(source, want):
    messages = [{"t": "p"}, {"t": "q"}]
    assert chat.Template(source).render(messages)[0] == want
    plain = chat.Template.__new__(chat.Template)
    plain.run = chat._closure(chat.parse(source))
    assert plain.render(messages)[0] == want


def test_values_of_the_wrong_kind_are_template_errors():
    for source in ("{{ 1 < 'a' }}", "{{ m + 1 }}", "{% for x in 5 %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(source).render([])


def test_conversations_with_clashing_columns_repeats_and_the_added_number(spark, tmp_path):
    from quillspark.llm.queries import op5_chat_format

    rows = [(-1, 0, "user", "mine", "x"), (5, 1, "assistant", "b", "x"), (5, 0, "user", None, "x"), (5, 0, "user", None, "x"), (None, 0, "user", "n", "x"), (6, 0, "assistant", "y" * 100_000, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r["conv_id"] is None, r["conv_id"] or 0, r["n_turns"], r["loss_chars"], r["turns_sha256"]) for r in op5_chat_format(spark, str(tmp_path)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert got == sorted([
        (False, -1, 1, 0, sha("user\nmine\n")), (False, -1, 2, len(said), sha(f"user\n{said}\nassistant\n{said}\n")), (False, 5, 3, 1, sha("user\n\nuser\n\nassistant\nb\n")),
        (True, 0, 1, 0, sha("user\nn\n")), (False, 6, 1, 100_000, sha("assistant\n" + "y" * 100_000 + "\n")),
    ])
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_boilerplate_in_the_middle_of_an_article_loses_nothing():
    weights = html_extract.learned_weights()
    words = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n))
    aside = lambda n: "<aside class='related'><h3>Related</h3><ul>" + "".join(f"<li><a href='#'>link{i} more</a></li>" for i in range(n)) + "</ul></aside>"
    for n in (5, 50, 100, 2000):
        for box in ("<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='content'>{}</div>", "<main><div><section>{}</section></div></main>"):
            inner = f"<p>{words('a', 20)}</p>{aside(n)}<p>{words('b', 200)}</p>{aside(n)}<p>{words('c', 10)}</p>"
            page = f"<html><body><nav><ul><li><a>Home</a></li><li><a>About us</a></li></ul></nav>{box.format(inner)}<footer><p>All rights reserved by us</p></footer></body></html>"
            assert html_extract.extract(page, weights) == f"{words('a', 20)} {words('b', 200)} {words('c', 10)}", (n, box)
