import random
import textwrap

from newsloom.llm import license_scan as L

from .conftest import SF

TOY = {1: "Alpha rules apply", 2: "Beta follows alpha", 3: "Gamma may follow"}
RULES = (("Long", (1, -3, 2)), ("Short", (1,)), ("Tail", (2, 2)))


def test_rules_in_order():
    scan = L.Scanner(TOY, RULES).scan
    licenses = lambda t: [(m[0], m[2]) for m in scan(t)]
    assert licenses("ALPHA  rules apply. Beta follows (alpha)!") == [("Long", [1, 2])]
    assert licenses("Alpha rules apply.\nGamma may\nfollow.\nbeta follows alpha.") == [("Long", [1, 3, 2])]
    assert licenses("Alpha rules apply. other. Alpha rules apply. Gamma may follow. x") == [("Short", [1]), ("Short", [1]), (None, [3])]
    assert licenses("Beta follows alpha. Beta follows alpha. Beta follows alpha.") == [("Tail", [2, 2]), (None, [2])]
    assert licenses("Alpha rules apply to all. alphabeta") == [] and licenses("") == [] and scan(None) == []
    # identifiers are whole numbers in the pattern
    assert [m[0] for m in L.Scanner({11: "Eleven here", 1: "One here"}, (("One", (1,)),)).scan("Eleven here. One here.")] == [None, "One"]


def test_places():
    text = "é intro\n  Alpha rules apply. tail"
    ((_, _, _, start, end),) = L.Scanner(TOY, RULES).scan(text)
    assert text[start:end] == "Alpha rules apply"


def test_edges(edge_docs, no_docs):
    assert L.license_matches(edge_docs).count() == 0 and L.license_matches(no_docs).count() == 0
    rows = L.license_matches(edge_docs, {1: "A b c d e f g"}, ()).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(1, None), (2, None), (2, None)]


def test_every_rule_by_its_own_text():
    """Each rule's sentences, also with a word a line and with the other spelling, are found as its licence."""
    scan = L.Scanner(L.NOTICES, L.NOTICE_RULES).scan
    for name, ids in L.NOTICE_RULES:
        text = ". ".join(L.NOTICES[abs(i)] for i in ids) + "."
        for form in (text, text.replace(" ", "\n"), textwrap.fill(text, 30, break_long_words=False, break_on_hyphens=False), text.replace("License", "Licence").replace("icensed", "icenced")):
            assert [m[0] for m in scan(form)] == [name], form


def test_every_sentence_alone():
    """Each built-in sentence is known by its own text, at any width, in running text and between other lines."""
    scanner = L.Scanner(L.NOTICES, L.NOTICE_RULES)
    assert len(scanner.known) == len(L.NOTICES)  # no two are alike
    for i, text in L.NOTICES.items():
        for form in (text, text.upper(), f"Copyright 2020 Someone.\n{text}.\nMore follows", *(textwrap.fill(text, w, break_long_words=False, break_on_hyphens=False) for w in (20, 40, 72))):
            assert i in {x for m in scanner.scan(form) for x in m[2]}, form


def test_rules_against_plain_matching():
    """Ordered rules over sequences of identifiers, against a search place by place, on random sequences of the real table."""
    random_ = random.Random(6)
    scanner, texts = L.Scanner(L.NOTICES, L.NOTICE_RULES), L.NOTICES
    used = sorted({abs(i) for _, ids in L.NOTICE_RULES[:24] for i in ids})

    def ways(ids):
        out = [()]
        for i in ids:
            out = [w + (abs(i),) for w in out] + ([*out] if i < 0 else [])
        return sorted(out, key=len, reverse=True)

    for _ in range(150):
        seq = random_.choices(used, k=random_.randint(1, 9))
        free, want = list(seq), []
        for name, ids in L.NOTICE_RULES:
            at = 0
            while at < len(free):
                hit = next((w for w in ways(ids) if w and tuple(free[at : at + len(w)]) == w), None)
                if hit:
                    want.append((at, name, list(hit)))
                    free[at : at + len(hit)] = [0] * len(hit)
                at += len(hit) if hit else 1
        want += [(at, None, [x]) for at, x in enumerate(free) if x]
        got = [(m[0], m[2]) for m in scanner.scan("\n\n".join(texts[i] + "." for i in seq))]
        assert got == [w[1:] for w in sorted(want)], seq


def test_stops_end_other_sentences():
    scan = L.Scanner({1: "See the list, v. 2 here", 2: "See the list", 3: "v 3 here"}, ()).scan
    found = lambda t: [m[2] for m in scan(t)]
    assert found("See the list, v. 2 here.") == found("See the list, v.\n2\nhere") == found("See the list v 2 here") == [[1]]
    assert found("See the list. v 3 here") == [[2], [3]] and found("See the list.\n\nv 3 here") == [[2], [3]]
    assert found("See the. list v 2 here") == found("See the list, v\n\n2 here") == found("v. 3 here") == []


def test_query_finds_all_planted_lines(spark, documents):
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    want = sorted((r.doc_id, k) for r in documents.collect() for k, line in lines.items() for x in r.text.split("\n") if x == line)
    assert "CC-BY-NC-4.0" in {k for _, k in want} and sorted((r.doc_id, r.license) for r in L.op4_license_scan(spark, SF).collect()) == want
