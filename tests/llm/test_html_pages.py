"""HTML extraction: what belongs to an article, unclosed elements, templates the model hasn't seen."""

import random

import pytest

from stintlake.llm import html

P = "<p>Some long text of the page, which says much. And more of it is here.</p>"
TEXT = "Some long text of the page, which says much. And more of it is here."


@pytest.fixture(scope="module")
def model():
    return html.default_model()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><h1>Title</h1>{P}<ul><li>First point.</li><li>second</li></ul></body>", ["Title", TEXT, "First point.", "second"]),
        (f"<article><header><h1>Head</h1></header>{P}</article>", ["Head", TEXT]),
        (f"<article>{P}<dl><dt>Term</dt><dd>Meaning.</dd></dl></article>", [TEXT, "Term", "Meaning."]),
        (f"<article>{P}<table><caption>Cap</caption><tr><td>1</td></tr></table></article>", [TEXT, "Cap", "1"]),
        ("<article><p>Energy is <math><mi>E</mi></math> by law.</p></article>", ["Energy is E by law."]),
        ("<article><p>Energy.</p><noscript>Kept words here.</noscript></article>", ["Energy.", "Kept words here."]),
        (f"<nav><a href=x>Home</a></nav><noscript>Please enable it.</noscript><article>{P}</article>", [TEXT]),
        ("Just plain text. Two  words", ["Just plain text. Two words"]),
        ("words", ["words"]),
        (f"<article>{P}<button>Share{P}{P}</article>", [TEXT] * 3),
        (f"<article>{P}<svg><path/>{P}</article>", [TEXT] * 2),
        (f"<article>{P}<button><div>Share</div></button>{P}</article>", [TEXT] * 2),
        (f"<body class='has-sidebar menu-open'><article class='no-sidebar'>{P}{P}</article></body>", [TEXT] * 2),
        ("", []),
        ("<script>var x = 1;", []),
    ],
)
def test_what_belongs_to_the_article(model, page, text):
    assert html.main_text(page, model) == "\n\n".join(text)


@pytest.mark.parametrize("template", [t for t in html.TEMPLATES if t != "plain"])
def test_template_that_the_model_has_not_seen(template):
    pick = random.Random(5)
    others = tuple(t for t in html.TEMPLATES if t != template)
    model = html.train([html.labelled_page(pick, others) for _ in range(html.TRAINING_PAGES)])
    right = seen = 0
    for _ in range(40):
        blocks, labels = html.labelled_blocks(html.labelled_page(pick, (template,)))
        for block, label, belief in zip(blocks, labels, model.marginals(blocks)[0], strict=True):
            if block.parts:
                seen += 1
                right += (belief > 0.5) == label
    assert right >= 0.9 * seen


def test_very_long_page_and_clashing_columns(spark):
    long = "<nav><a href=x>Home</a></nav><article>" + P * 20000 + "</article>"
    rows = [(1, "u", long, "a", 7), (2, "v", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    found = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert found[1]["text"] == "\n\n".join([TEXT] * 20000) and found[1]["n_chars"] == len(found[1]["text"])
    assert found[2]["text"] == "" and found[2]["n_chars"] == 0
