import math
import re
import textwrap

import pytest

from cardloom.llm import license_scan as L
from cardloom.llm import license_templates as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def said(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def tokens(ws):
    return [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]


def by_force(text):
    """Every window of words of twice a template's length that begins at a multiple of it, for every template."""
    ws, starts, base = said(text), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    labels, score, all_tokens = set(base), 1.0 if base else 0.0, tokens(ws)
    for label, wording, phrase in L.TEMPLATES:
        span, musts = len(said(wording)), set(tokens(said(phrase)))
        whole = {*tokens(said(wording)), *musts}
        if len(whole & set(all_tokens)) < 0.8 * len(whole):
            continue
        for at in range(0, len(all_tokens), span):
            common = whole & set(all_tokens[at : at + 2 * span])
            if len(common) >= math.ceil(0.8 * len(whole) - 1e-9) and musts <= common:
                labels.add(label)
                score = max(score, len(common) / len(whole))
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def wrapped(text, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, 75))


WHOLE = {label + str(len(w)): w for label, w, _ in L.TEMPLATES}
TEXTS = [
    "Mit License", "the MIT License, mit license", "x\nApache\nLicense y", "general public license General Public License", "permitted", "summit license", "É mit license é", "mit  -- LICENSE",
    "intro\nLicensed under CC BY-NC 4.0.\nmore", "Licensed under CC BY 4.0", T.GRANT, " ".join(T.BSD_CONDITION.split()[3:]), " ".join(T.BSD_CONDITION.split()[6:]),
    T.MPL_NOTICE + "\n" + T.UNLICENSE, T.UNLICENSE.replace("domain", "").replace("into", ""), None, "", "\n\n", "nothing to see here 漢字", "two words", "three short words",
    " ".join(reversed(T.ISC.split())), "mit license " * 3000, "a b c " * 5000 + wrapped(T.MIT) + " d e f" * 5000, wrapped(T.MIT, " * ") * 2, *WHOLE.values(),
    *(" ".join(w.split()[: len(w.split()) * 5 // 6]) for w in WHOLE.values()), *(" ".join(w.split()[len(w.split()) // 4 :]) for w in WHOLE.values()),
]


def test_against_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "mit license", None, None), (3, TEXTS[3], "x", 1)], "doc_id long, text string, labels string, n_words int").repartition(2)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in L.scan(docs).collect())
    assert got == sorted((str(r.doc_id), *by_force(r.text)) for r in docs.collect())
    assert not L.scan(docs.where("false")).count()


CASES = {
    "Licensed under CC BY 4.0": "cc-by", "All of it is licensed under CC BY-SA 4.0, as said.": "cc-by-sa", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "we released the pigeons under the old license last year": "", "Licensed under the Eclipse License, Version 2.0": "", wrapped(T.GRANT): "mit", wrapped(T.MIT, "// "): "mit",
    wrapped(T.BSD_CONDITION, "# "): "bsd", wrapped(T.BSD_TWO + T.BSD_END): "", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by", wrapped(T.GNU_NOTICE.format(T.GNU["lgpl"])): "gpl,lgpl", wrapped(T.GNU_NOTICE.format(T.GNU["gpl"])): "gpl",
    wrapped(T.EPL_NOTICE, " * ") + " 2.0": "epl", T.ZLIB: "zlib", T.BOOST: "bsl",
}


def test_labels(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in L.scan(docs).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())


@pytest.mark.parametrize("name", T.FILES)
def test_whole_licenses(name):
    label = T.FILES[name][0]
    text = next(w for x, w, _ in L.TEMPLATES if x == label and w == open(f"{T.FOLDER}/{name}.txt", encoding="utf-8").read())
    assert label in by_force(text)[5].split(",")


def test_the_plan_does_not_grow(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    size = lambda t: L.scan(docs, t)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(L.TEMPLATES[:2]) == size(L.TEMPLATES)
