import pytest

from lodestone.llm import residue as R

KNOWN = {"first_name", "summary"}


def kinds(text):
    return {k if k != "maybe" else "variable" for k, _, v in R.signals(text) if k not in ("likely", "page", "beside") and (k != "maybe" or v in KNOWN)}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Dear {{first_name}},\n\nwe changed it.", "variable"), ("# ${SUMMARY}", "variable"), ("Owner: %(first_name)s", "variable"), ("Hallo <%= a %>, gut", "variable"), ("@@DATE@@", "variable"), ("by __FIRST_NAME__.", "variable"), ("[INSERT DUE DATE]", "variable"), ("Owner: <your first name>", "variable"), ("[[summary]]", "variable"),
        ("{summary} replaces <<summary>>", "variable"), ("by [first name here].", "variable"), ("404 Not Found", "error"), ("HTTP/1.1 502 Bad Gateway\nThe server met an unexpected condition and gave up.", "error"), ("# n_cst_a\n\nServer error: 500\nPlease try again.", "error"), ("ZUGRIFF VERWEIGERT. Bitte melden Sie sich an. (123)", "error"),
        ("Η ΣΕΛΊΔΑ ΔΕΝ ΒΡΈΘΗΚΕ.", "error"), ("ページが見つかりません (404)", "error"), ("服务器内部错误 500，请稍后再试。", "error"), ("Menu\n\nSomething  went   wrong!\n\nBack to top", "error"), ("Please enable JavaScript to view this page.", "notice"), ("This app requires scripts.", "notice"), ("noscript: the viewer was not loaded", "notice"),
        ("Veuillez activer JavaScript pour afficher cette page.", "notice"), ("Lorem ipsum dolor sit amet, quam arcu.", "filler"), ("asdf, asdf, asdf, asdf", "filler"), ("n_cst_a: description to be added. Content to follow.", "filler"), ("Topic 1\r\n\r\nSome text of this section will follow.", "filler"), ("Your text​ goes here.", "filler"),
    ],
)
def test_cases(text, kind):
    assert kind in kinds(text)
    assert kind in kinds("A real sentence about of_read_row in base.pbl.\n\n" + text)


@pytest.mark.parametrize(
    "text",
    [
        None, "", " \n ", "n/a", "Merged.", "test", "TODO: check of_a in w_b.", 'Users who open w_a get "404 Not Found" since version 4.', "The mail writer of_a fills `{{summary}}` and `${summary}` from t_b.", '```\nls_t = "${HOME}"\nx = {{summary}}\n```\nThis script builds the text.', "Angle brackets: <any>, <T> and list<string> are types.",
        "Test data: the field a_b held \"lorem ipsum\" in 5 rows.", "Error handling in of_a: on 403 it writes a row to t_b, and on 503 it waits.", "The embedded browser of n_cst_a needs scripts.", "Why JavaScript? The old client of w_a ran in the browser.", "The page about error pages: each status code has one row in t_b.", "Log:\n```\nGET /items/7 404\nPOST /items 500 Internal Server Error\n```\nThe 500 comes from of_a.",
        "Die Meldung \"Seite nicht gefunden\" stammt aus of_a.", "if {1, 2, 3} then a[1] = b_c", "Error establishing the connection, code 5. The retry in of_load_x never runs.",
    ],
)
def test_no_cases(text):
    assert kinds(text) == set()


def test_corpus_rules(spark):
    docs = [(1, "Dear {{team}},"), (2, "Hallo <team>, hier"), (3, "a list<string> and <other>"), (None, "404 Not Found"), (5, None), (6, ""), (7, "404 Not Found"), (8, "The error was unavailable here"), (9, "The error was unavailable here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kind string")
    assert {r.doc_id for r in R.residue(df).collect()} == {1, 2, None, 7}
    assert {r.doc_id for r in R.residue(df, repeats=2).collect()} == {1, 2, None, 7, 8, 9}
    counts = {(r.kind, r.template): r.n_docs for r in R.templates(R.residue(df)).collect()}
    assert counts[("variable", "Dear ¤,")] == 1
    assert R.residue(df.limit(0)).count() == 0


def test_long_text_is_read_whole():
    assert kinds("word of_a. " * 100_000 + "\n\n404 Not Found") == {"error"}


def test_slots_are_induced_from_records(spark):
    own = [(i, f"Owner: person {i}\nStatus: {'open' if i % 2 else 'closed'}\nShip it to depot_{i} by day {i}.") for i in range(20)]
    odd = [(100 + i, "Owner: nobody yet\nStatus: open") for i in range(10)]
    more = [(200, "Owner: ____\nStatus: open"), (201, "Owner:\nStatus: closed"), (202, "Owner: <sponsor>"), (203, "Owner: first_name"), (204, "Hello ${first_name}"), (205, "Ship it to ____ by day ___."), (206, "Nobody else has ____ here."), (207, "Owner:\n- a list"), (208, "Other: ____"), (209, "")]
    df = spark.createDataFrame(own + odd + more, "doc_id long, text string")
    found = {(r.doc_id, r.kind) for r in R.residue(df).collect()}
    assert found == {(100 + i, "default") for i in range(10)} | {(200, "blank"), (201, "blank"), (202, "variable"), (203, "variable"), (204, "variable"), (205, "blank")}


def test_long_blocks_and_templates_are_kept_apart(spark):
    page = "We are sorry that what was asked for is unavailable now " + "and that it may stay so for a while " * 10
    line = "and so on " * 30
    docs = [(i, page) for i in range(3)] + [(3, f"{line} {{{{team}}}} one"), (4, f"{line} {{{{team}}}} two")]
    found = R.residue(spark.createDataFrame(docs, "doc_id long, text string")).cache()
    assert {r.doc_id for r in found.collect()} == {0, 1, 2, 3, 4}
    assert sorted(r.n_docs for r in R.templates(found).collect()) == [1, 1, 3]


@pytest.mark.parametrize("text", ["The page you wanted went missing. Return home.", "Votre page n'existe plus.", "Страница не найдена", "We apologize, but the page could not be located.", "Diese Seite existiert leider nicht.", "La sesión ha caducado.", "Connection to the gateway timed out.", "Pagina non trovata"])
def test_wordings_that_no_list_holds(text):
    assert "error" in kinds(text)


@pytest.mark.parametrize("text", ["Dear *|FIRST_NAME|*,", "Hello {{ user.name | title }}!", "Owner: ${one_two_three_four_five_six_seven}"])
def test_more_delimiters(text):
    assert "variable" in kinds(text)


def test_what_fills_a_page_template(spark):
    """Whatever stands where others of the template have known wording is residue too; a sentence that stands in other blocks as well is no template."""
    known = [(i, "Page not found. Kindly ring the porter.") for i in range(4)]
    odd = [(10, "Alas, the gremlins ate this whole page. Kindly ring the porter."), (11, "A good read. It has no error left.")]
    often = [(20 + i, "Access denied. We thank you.") for i in range(3)] + [(30 + i, f"Release {i} fixes an error for all of us. We thank you.") for i in range(6)]
    found = {r.doc_id for r in R.residue(spark.createDataFrame(known + odd + often, "doc_id long, text string")).where("kind = 'slot'").collect()}
    assert found == {10}


def test_bare_status_and_undecided_values(spark):
    docs = [(i, "404") for i in range(3)] + [(5, "7"), (6, "Owner: TBD\nStatus: open")] + [(10 + i, f"Owner: person {i}\nStatus: open") for i in range(5)]
    assert {r.doc_id for r in R.residue(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {0, 1, 2, 6}
