"""Whole texts and notices are accepted in any layout, and copies with another wording aren't."""

import random
import re

import pytest

from corpusloom.llm import licence_texts, licences


def written(template, r):
    """A text that a template accepts: optional parts are there or not, regions are filled, layout is free."""
    out, at = [], 0
    tokens = re.findall(r"\[|\]|\||<\d+(?:,\d+)?>|[^\s\[\]|<>]+", template)

    def sequence():
        nonlocal at
        words = []
        while at < len(tokens) and tokens[at] not in "]|":
            t = tokens[at]
            at += 1
            if t == "[":
                choices = [[]]
                while True:
                    choices.append(sequence())
                    at += 1
                    if tokens[at - 1] == "]":
                        break
                words += r.choice(choices)
            elif t[0] == "<":
                low, _, high = t[1:-1].partition(",")
                words += ["acme"] * r.randint(int(low), int(high or low))
            else:
                words.append(t)
        return words

    for w in sequence():
        out += [r.choice([w, w.upper(), w.title()]), r.choice([" ", "  ", ", ", "\n", "\n   * ", ' "', ") "])]
    return "".join(out)


@pytest.mark.parametrize("k", range(len(licences.PUBLISHED)))
def test_published_texts(k):
    label, template = licences.PUBLISHED[k]
    r, automaton, scanner = random.Random(k), licences.Automaton(template), licences.Scanner()
    for _ in range(3):
        text = "Some words before. " + written(template, r) + " and some after."
        found = licences.scan_texts([text.encode()], scanner)
        assert label in found["labels"][0].split(",") and found["score"][0] == 1.0
        words = re.findall(r"[0-9a-z]+", text.lower())
        start = next(i for i in range(len(words)) if automaton.match([w.encode() for w in words], i) > 0)
        mandatory = [i for i in range(start + 3, len(words) - 3) if words[i] not in ("acme",) and len(words[i]) > 5]
        place = r.choice(mandatory[len(mandatory) // 3 : len(mandatory) // 2] or mandatory)
        altered = [w.encode() for w in words]
        altered[place] = b"otherwise1"
        full = automaton.match([w.encode() for w in words], start)
        assert automaton.match(altered, start) != full or re.search(r"[\[<]", template)


def test_sizes():
    """Whole texts are whole: their words are counted."""
    words = {label: max(licences.Automaton(t).mandatory for name, t in licences.PUBLISHED if name == label) for label, _ in licences.PUBLISHED}
    assert words["apache-2.0"] > 1400 and words["unlicense"] > 190 and words["zlib"] > 120 and words["bsl-1.0"] > 190 and words["gpl-3.0"] > 60 and words["lgpl-2.1"] > 60


def test_an_altered_licence_has_no_label():
    text = licence_texts.UNLICENSE
    scanner = licences.Scanner(tuple(x for x in licences.PUBLISHED if x[0] == "unlicense"))
    assert licences.scan_texts([text.encode(), text.replace("commercial or non", "charitable or non").encode()], scanner)["labels"] == ["unlicense", ""]


def test_a_whole_licence_file(spark):
    notice = licence_texts.GNU_NOTICE.replace("{licence}", "Lesser General Public License").replace("{version}", "3").replace("[", "").replace("]", "").replace("<1,4>", "Tool")
    rows = [(1, "My tool\n" + licence_texts.APACHE_2.replace("[http|https]", "http://").replace("[", "").replace("]", "")), (2, "Tool " + notice), (3, "nothing here"), (4, None)]
    got = {r["doc_id"]: r["labels"] for r in licences.licence_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "apache-2.0" in got[1].split(",") and "lgpl-3.0" in got[2].split(",") and got[3] == got[4] == ""
