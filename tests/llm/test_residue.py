import pytest

from gridloom.llm import residue

DIFF = "diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1,1 +1,2 @@\n-a\n+b\n"


def _git(message, diff=DIFF, author="A B <a@b.example>"):
    body = "\n".join("    " + s for s in message.split("\n"))
    return f"commit {'0af3' * 10}\nAuthor: {author}\nDate:   2021-03-01 10:00:00 +0100\n\n{body}\n\n{diff}"


def _mail(subject, body="", diff=DIFF):
    return f"From {'0af3' * 10}\nFrom: A <a@b.example>\nDate: 2021-03-01\nSubject: [PATCH 1/3] {subject}\n\n{body}\n---\n 1 file(s) changed\n\n{diff}-- \n2.1\n"


def _hg(message, rest=DIFF):
    return f"changeset:   12:{'0af3' * 3}\nuser:        A <a@b.example>\ndate:        2021-03-01\ndescription:\n{message}\n\n\n{rest}"


CASES = [
    _git("{{ title }}"), _git("Fix cache\n\n## Why\n${motivation}"), _git("Fix cache for <one-line summary>"), _git("[SUBJECT]: Fix cache"), _git("Fix cache (%(ticket)s)"), _git("Fix", author="A B <[[email]]>"), _git("Fix", author="{{ author name }} <a@b.example>"),
    _git("Fix\n\nDescribe what changed and why it was needed."), _git("Fix\n\nRisk: TODO: write the release before merging"), _git("Fix\n\n<!-- Keep the title under 50 characters, then delete this comment -->"),
    _git("Lorem ipsum dolor sit amet consectetur."), _git("Fix\n\nbla bla bla bla bla bla"), _git("asdf jkl wer qas dfjk"), _git("Fix\n\nxxxx XXXX .... xxxx ----"),
    _git("Fix", "HTTP 503\nOops! Something went wrong while loading this diff.\n"), _git("Fix", "Please enable JavaScript to view this page.\n"), "404 Not Found\n\nLa page demandée est introuvable.", '{"error": {"status": 500, "message": "x", "trace": "0afbc12345"}}',
    "<noscript>This page works only with JavaScript enabled.</noscript>", _mail("Fix", diff="fatal: could not render view (timeout after 3 s)\n"), _mail("{{ scope }}"), _mail("Fix", "How\n---\n%TICKET%"), _hg("Fix", "Diese Seite wurde nicht gefunden.\n"), _hg("__TITLE__"),
    "* 0af3c9d11 Fix ({{ ticket }}) (A B, 2021-03-01)\n" + DIFF, "* 0af3c9d11 Fix (A B, 2021-03-01)\nYour session has ended. Sign in to continue.\n", "commit を表示するには JS を有効にしてください。", "﻿\r\n" + _git("{{title}}").replace("\n", "\r\n"),
]
OTHERS = [
    None, "", " \n\t", _git("Rename {{ title }} in the welcome template"), _git("Fail when [SUBJECT] is left unfilled"), _git("Accept ${name} as a key in the form"), _git("Escape <summary> before the mail is sent"), _git("Replace lorem ipsum in the sample page"),
    _git("Reword 'Please enable JavaScript' on the start page"), _git("New look for the 404 page"), _git("Wait for the cache\n\nThe log showed:\n    > HTTP 503\n    > Oops! Something went wrong while loading this diff.\nso it waits."),
    _git("Fix", DIFF + "+{{ title }}\n+Lorem ipsum dolor sit amet\n+404 Not Found\n+Please enable JavaScript to view this page.\n"), _git("Apply formatter [skip checks]"), _git("[io] Fix cache"), _git("<|endoftext|> marker test"), _git("Merge branch 'a'", ""),
    _mail("Show a notice when JavaScript is disabled"), _hg("ok"), "* 0af3c9d11 Update lock file (dep[bot], 2021-03-01)\n" + DIFF, _git("…"), _git("Reviewed as is", "").rstrip(),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "s", "r", i, "l") for i, t in enumerate(CASES + OTHERS)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, source string, role string, records long, line string")
    return {r.doc_id for r in residue.residue(df).collect()}, df


def test_cases_and_others(found):
    got, _ = found
    missed = [t for i, t in enumerate(CASES) if i not in got]
    wrong = [t for i, t in enumerate(OTHERS) if i + len(CASES) in got]
    assert not missed and not wrong


def test_exclusion_keeps_the_rest(spark, found):
    got, df = found
    left = residue.without_residue(df.dropDuplicates(["doc_id"]))
    assert {r.doc_id for r in left.collect()} == set(range(len(CASES) + len(OTHERS))) - got
    assert left.columns == df.columns
    assert residue.residue(df.limit(0)).count() == 0


def test_an_unknown_page_counts_if_it_recurs(spark):
    page = lambda i: f"Kaputt, bitte spaeter wieder kommen (Vorgang {i})"
    rows = [(i, _git("Fix", page(i)), "ab"[i % 2]) for i in range(6)] + [(10, _git("Fix", "Something seen once"), "a")] + [(20 + i, _git("Fix", "Only here, often"), "a") for i in range(9)]
    # the same words as somebody's whole text are a page's, too; as a message they are not
    rows += [(40, page(77), "c"), (41, _git(page(78)), "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {(r.doc_id, r.reason) for r in residue.residue(df).collect()} == {(i, "recurring page") for i in [*range(6), 40]}


UNSEEN_PAGES = [
    "JavaScript must be enabled to use this site.", "Access denied", "Site temporarily unavailable", "The requested URL was not found on this server.", "This page isn't available", "Connection timed out",
    "We're sorry, an error occurred", "Service is down for maintenance", "Enable cookies and JavaScript to continue", "503 Service Temporarily Unavailable", "Zugriff verweigert", "Accès refusé", "Доступ запрещён",
]
UNSEEN_MESSAGES = [
    "Placeholder text goes here", "[Insert ticket number]", "<PLACEHOLDER>", "blah blah blah", "TODO: describe the change before submitting", "<!-- Please describe your changes -->", "[Your name]", "{{ cookiecutter.title }}",
    "Enter your commit message here", "Please enter a description of your change", "This is placeholder text.", "Delete this line before committing", "${JIRA_ID}", "[TITLE]: fix", "Aquí va el texto de relleno",
]
ORDINARY = [
    "Describe the parser in the docs", "Replace this loop by a map", "Delete the dummy text", "Remove placeholder from the form", "Explain why the cache is slow", "[WIP]", "[docs] fix", "Add the missing header", "Write tests for this change",
    "Remove this line from the makefile", "Use {name} as key", "Return 404 when not found", "Add sample text to the docs", "Delete file before sending", "Add note about why this is needed", "List changes in the release note", "<T> bound is optional", "Add title to the link",
]


def test_sentences_never_seen_are_judged_by_their_words():
    page = lambda x, role: residue._verdict(role, residue._mask(x), 1, 1)
    assert [x for x in UNSEEN_PAGES if not page(x, "page")] == []
    assert [x for x in UNSEEN_MESSAGES if not page(x, "message")] == []
    assert [x for x in ORDINARY if page(x, "message")] == []
    assert [x for x in ["Fix error in parser", "Handle missing page", "Show a notice when JavaScript is disabled", "Use scripts without shell"] if page(x, "whole")] == []
