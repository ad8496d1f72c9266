"""What the operators once left out: one test for each finding of a review."""

import math

import pytest

from marketlake.llm import html_layout, importance, licenses

ROOT = "/root/testdata"


def labelled(llm, sf):
    """The documents and labels of a size, and the trusted documents."""
    docs, labels = (llm.read.parquet(f"{ROOT}/{sf}/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.groupBy("doc_id").agg({"quality": "min", "toxic": "max"}).where("`min(quality)` = 1 AND `max(toxic)` = 0")
    return docs, labels, docs.join(trusted, "doc_id", "left_semi")


def test_clean_texts_stay_whatever_their_length(llm):
    docs, labels, trusted = labelled(llm, "sf0.1")
    words = {}
    for r in trusted.where("text IS NOT NULL").select("lang", "text").collect():
        words.setdefault(r.lang, []).extend(r.text.split(" "))
    rows = [(n, " ".join((w * (n // len(w) + 1))[:n])) for w in words.values() for n in (10_000, 100_000, 1_000_000)]
    counts = importance.models(docs, labels)
    bins = importance.trusted_weights(docs, labels, counts).toPandas()
    m = importance.margin(bins["w"].to_numpy(), bins["n"].to_numpy())
    got = importance._keyed(llm.createDataFrame(rows, "doc_id long, text string"), counts, 0)
    drawn = [1 - math.exp(-math.exp(min(r.log_weight + m, 50))) for r in got.select("log_weight").collect()]
    assert len(drawn) == 12 and min(drawn) > 0.95 and sum(drawn) / 12 >= importance.KEEP_TRUSTED


def test_word_order_counts_in_the_classifier(llm):
    words = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join(words * 4)) for i in range(40)] + [(i, " ".join(words[::-1] * 4)) for i in range(40, 80)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    labels = llm.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in importance.resample(docs, labels).where("kept").collect()} == set(range(40))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_few_labels_make_witnesses(llm, sf):
    docs, labels, trusted = labelled(llm, sf)
    kept = {r.doc_id for r in importance.resample(docs, labels).where("kept").select("doc_id").collect()}
    insults = "trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron"
    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").where(f"regexp_count(text, '{insults}') >= 3")
    assert not {r.doc_id for r in toxic.collect()} & kept
    assert {r.doc_id for r in trusted.collect()} <= kept


def test_a_word_repeated_by_few_toxic_texts_is_no_witness(llm):
    rows = [(i, f"plain words of text {i} " + ("rewh" if i % 9 == 0 else "")) for i in range(300)]
    rows += [(i, f"plain words of text {i} " + ("rewh " * 600 if i < 303 else "moron scum idiot")) for i in range(300, 340)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    labels = llm.createDataFrame([(i, 1, int(i >= 300)) for i in range(340)], "doc_id long, quality int, toxic int")
    safe = {r.doc_id: r.safety for r in importance.scored(docs, importance.models(docs, labels)).collect()}
    assert all(safe[i] == 0 for i in range(300)) and all(safe[i] < -5.5 for i in range(303, 340))


def test_no_visible_text_of_a_page_is_lost_or_glued():
    render = html_layout.render
    assert render('<div class="a"">one two</div><p>three</p>') == "one two\n\nthree"
    assert render('<img alt="5" tall"><p>the rest') == "the rest" and render("<a href=x title=don't>it</a> isn't") == "it isn't"
    assert render("""<a title="a > b" alt = 'c > d' href=/x?q="1>in</a> <b title=x'hidden>seen</b> <i "hidden">too""") == "in seen too"
    assert render("<table><tr><td colspan=2>Population in thousands<td>Area<tr><td>2001<td>2011<td>km2</table>").split("\n") == [
        "Population in thousands  Area", "2001        2011         km2"]
    assert render("a<svg><title>no</title><defs><text>no</text></defs><text>b</text><path d='M0'/><text>c</text></svg>d") == "a b c d"
    assert render("<p>so <math><mfrac><mn>1</mn><mn>2</mn></mfrac><mo>=</mo><mi>x</mi><annotation>no</annotation></math>, yes") == "so 1 2 = x , yes"


def test_exact_notices_are_found_in_running_text():
    scan = licenses.Scanner()
    for filler in ("so it is as we do on to an if at by of he", "internationalization characteristically misunderstanding"):
        for name, notice in licenses.TEMPLATES:
            text = f"{filler} {filler} {filler} {notice} {filler} {filler} {filler}"
            assert [(f["license"], f["missing"], f["added"]) for f in scan(text)] == [(name, [], [])], (name, notice)


def test_version_and_identity_words_tell_licenses_apart():
    scan = licenses.Scanner()
    names = lambda text: [f["license"] for f in scan(text)]
    known = dict(reversed(licenses.TEMPLATES))
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0-or-later")
    assert names(gpl) == ["GPL-3.0-or-later"] and names(gpl.replace("version 3", "version 2")) == ["GPL-2.0-or-later"]
    assert names(gpl.replace("version 3", "version 7")) == [] and names(gpl.replace("GNU General", "GNU Lesser General")) == ["LGPL-3.0-or-later"]
    assert names(known["LGPL-3.0-only"]) == ["LGPL-3.0-only"] and names(known["LGPL-3.0-only"].replace("3.", "2.1.")) == ["LGPL-2.1-only"]
    three = next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause")
    two = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause")
    assert names(three) == ["BSD-3-Clause"] and names(two) == ["BSD-2-Clause"]
    assert names(two.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")) == ["BSD-2-Clause"]
    assert names(two.split(":")[0] + ": and so on") == ["LicenseRef-BSD"]
