import pytest

from lectio.llm import residue

HELD = [
    "{{page.title}}", "By ${author_name}, Paris", "<%= body_text %>", "{% block content %}{% endblock %}", "%%SUMMARY%%", "An essay on __MAIN_TEXT__ and law.", "[[SCHOLAR NAME]]", "[YOUR TEXT HERE]",
    "&lt;enter lecture notes&gt;", "<!-- content goes here -->", "TODO: write the introduction", "XXX replace with summary XXX", "{0} results for {1}", "$title$ by $author$", "%(excerpt)s", "@@CITATION@@",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit", "Your text goes here. Your text goes here.", "asdf asdf jkl", "Dies ist ein Blindtext.",
    "404 – Page not found", "Access denied. You do not have permission to view this text.", "Please enable JavaScript to view this page.", "Ce site a besoin de JavaScript pour fonctionner.",
    "A fine essay about law and grace.\nError 500: something went wrong on our side. Please try again later.\nMore of the essay.", "Bitte aktivieren Sie JavaScript, um den Inhalt zu sehen.",
    "Warning: query(): connection refused in /srv/page.inc on line 7", "Seite nicht gefunden. Bitte prüfen Sie die Adresse.", "Erreur 404 : la page demandÃ©e n'existe pas",
]
FREE = [
    None, "", "   \n ", "A sermon on grace.", "Comments need scripts to be turned on in your browser.", "The sum costs $5 and not ${} as Holgar printed it; 100% of the copies [...] agree.",
    "Let {x} be the set that holds only hope; then {x, y} orders it, and [sic] the copy agrees.", "Printers filled empty columns with lorem ipsum, which the cantor concedes to be a torn page about pain.",
    "The words dolor sit amet survive because the moral unity of contemplation measures later dominion.",
    "A reader who meets the words “404 not found” in a library learns, as the abbot maintains, that prophecy limits council, and that the page was never there at all, so it is said.",
    "The scripts of Paris are required reading, and you must enable the eye to follow them, as the monk maintains against all the others who came before.",
    "In this tutorial the template writes {{ name }} where the placeholder stands, and the syntax of the template engine replaces the variable when the page is made for a reader.",
    "Todos los derechos reservados",
]


@pytest.mark.parametrize("text", HELD)
def test_residue(text):
    assert residue.residue(text)


@pytest.mark.parametrize("text", FREE)
def test_no_residue(text):
    assert residue.residue(text) is None


def test_errors():
    for e in ("HTTP %d %s", "[error text]", "HTTP {code} {name}", "%%ERROR_MESSAGE%%", "Timed out after __SECONDS__ s", "${ex.Message}", "TODO error message", "Fetch of <URL> failed: <REASON>", "HTTP {0} {1}"):
        assert residue.error_template(e)
    for e in (None, "", "HTTP 404 NotFound", "Non-HTML content type: application/pdf", "The request timed out after 10 seconds.", "Blocked by robots.txt"):
        assert not residue.error_template(e)


def test_table(spark):
    rows = [(1, "{{a}}", None, "x"), (1, "{{a}}", None, "x"), (2, None, "HTTP %d", None), (3, "fine " * 100_000, "", None), (4, "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, text_content string, error string, kind string")
    got = sorted((r.page_id, r.field) for r in residue.find_residue(df).collect())
    assert got == [(1, "text_content"), (1, "text_content"), (2, "error")]
    assert residue.find_residue(df.limit(0)).count() == 0


def test_code_blocks_show_placeholders_and_long_lines_are_read_by_sentence():
    essay = "The law of grace orders the reason of the text as the reader knows. " * 6
    assert residue.residue(f"{essay}\n```\n<p>{{{{name}}}}</p>\n```\n{essay}") is None
    assert residue.residue(f"{essay}\n<pre>\n${{title}} %%NAME%%\n</pre>\n{essay}") is None
    assert residue.residue(f"{essay} as here:\n\n    {{{{name}}}}\n    {{% block %}}\n\n{essay}") is None
    assert residue.residue(f"{essay}\n```\ncode\n```\n{essay} {{{{name}}}}") == "placeholder"
    message = "404 Not Found. The page you are looking for might have been removed or renamed some time ago. The page could not be found on this server. Error 404 for this address."
    assert residue.residue(message) == "error"
    assert residue.residue(f"{essay} {message} {essay * 3}".replace("\n", " ")) is None
