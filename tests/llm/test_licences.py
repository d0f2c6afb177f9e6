"""Licence texts as files hold them: wrapped, with comment signs, and over blank lines."""

import textwrap

import pytest

from factorloom.llm import licences

S = licences.SENTENCES
MIT = f"Copyright (c) 2020 Someone\n\n{S['mit-grant']}:\n\n{S['mit-condition']}.\n\n{S['mit-warranty']}. IN NO EVENT SHALL THE AUTHORS BE LIABLE."
BSD = f"{S['bsd-grant']}:\n\n1. {S['bsd-source']}.\n2. {S['bsd-binary']}.\n\nTHIS SOFTWARE IS PROVIDED AS IS"
GPL2, GPL3 = (f"{S['gpl-free']}; {S[f'gpl-redistribute-{k}']}.\n\nThis program is distributed in the hope that it will be useful" for k in (2, 3))
APACHE = f"{S['apache-header']};\n{S['apache-may-not']}.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{S['apache-unless']}."
TEXTS = {"MIT": MIT, "BSD-2-Clause": BSD, "GPL-2.0-or-later": GPL2, "GPL-3.0-or-later": GPL3, "Apache-2.0": APACHE}


def wrapped(text, width, sign, feed="\n"):
    paragraphs = [textwrap.fill(p, width) if width else p for p in text.split("\n\n")]
    return feed.join(sign + line for line in "\n\n".join(paragraphs).split("\n"))


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licence"] for r in licences.scan(df).orderBy("doc_id").collect()]


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_wrapped_texts(spark, sign):
    cases = [(k, wrapped(t, w, sign, feed)) for k, t in TEXTS.items() for w in (0, 50, 72, 79) for feed in ("\n", "\r\n")]
    assert [r["licences"] for r in found(spark, [t for _, t in cases])] == [[k] for k, _ in cases]


def test_sentences_end_at_blank_lines_and_start_at_lines(spark):
    texts = ["Released under\nthe MIT License", "Released under\n\nthe MIT License", "It is released under the MIT License", "Copyright me\nReleased under\n  the MIT License\nand more", "a\x01Released under the MIT License\x01", "Released under the MIT License\nReleased under the MIT License. released under the mit license"]
    assert [len(r["sentence_ids"]) for r in found(spark, texts)] == [1, 0, 0, 1, 0, 3]


def test_every_licence_line_of_the_documents(spark, documents):
    """Each line that says under what a text is licensed or released is recognised."""
    said = documents.selectExpr("explode(split(text, '\n')) AS text").where("text rlike '(?i)(licensed|released) under'").distinct().selectExpr("text", "1 AS doc_id")
    rows = licences.scan(said).collect()
    assert rows and all(r["licence"]["licences"] for r in rows), rows


def test_more_licences(spark):
    texts = {
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": ["CC-BY-NC-ND-4.0"], "This work is licensed under CC BY-SA 3.0": ["CC-BY-SA-3.0"],
        BSD.replace("\n\nTHIS", f"\n3. {S['bsd-names']}.\n\nTHIS"): ["BSD-2-Clause", "BSD-3-Clause"], f"{S['isc-grant']}.": ["ISC"], f"{S['mpl-header']}. 2.0. {S['mpl-copy-s']}.": ["MPL-2.0"], f"{S['lgpl-free']}; {S['lgpl-redistribute-21']}.": ["LGPL-2.1-or-later"],
        f"{S['gpl-free']}: {S['agpl-redistribute-3']}.": ["AGPL-3.0-or-later"], f"{S['gpl-free']}; {S['gpl-only']}; {S['gpl-version-2']}.": ["GPL-2.0"], "Licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
    }
    assert [r["licences"] for r in found(spark, [wrapped(t, 60, "# ") for t in texts])] == list(texts.values())
