import re
import textwrap

from assayforge.llm.license_scan import CANDIDATE, TEMPLATES, Scanner, scan
from tests.conftest import SMALL
from tests.llm import cases


def test_every_template_finds_itself():
    s = Scanner()
    for name, text in TEMPLATES:
        found = s.block(text)
        assert found and found[0] == name and found[3] == [] and found[4] == []


def test_differences_in_wording():
    name, saved, share, missing, added = Scanner().block("This work is kindly licensed under the GNU General Public License, version 3")
    assert (name, missing, added) == ("GPL-3.0", [], ["kindly"]) and saved > 0 and 0 < share <= 1


def test_other_lines_are_left_alone():
    s = Scanner()
    assert s.block("A permission slip was needed for the school trip to the museum of modern art") is None
    assert list(s.scan("no notice here\nnor here")) == []


def test_same_as_exact_lines(spark):
    exact = {t: n for n, t in TEMPLATES}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {(r["doc_id"], k, exact[line.strip()]) for r in docs.collect() for k, line in enumerate((r["text"] or "").split("\n")) if line.strip() in exact}
    got = {(r["doc_id"], r["line"], r["license"]) for r in scan(docs).collect()}
    assert want and want <= got


def in_order(template, block):
    """Most words of the template that the block has in order, by dynamic programming."""
    row = [0] * (len(block) + 1)
    for w in template:
        last = row
        row = [0]
        for k, v in enumerate(block):
            row.append(last[k] + 1 if w == v else max(last[k + 1], row[k]))
    return row[-1]


def test_no_notice_without_its_words(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = scan(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert found
    for r in found:
        text = [w.lower() for w in re.findall(r"\w+(?:[.-]\w+)*", "\n".join(docs[r["doc_id"]].split("\n")[r["line"] :]))]
        wordings = [[w.lower() for w in re.findall(r"\w+(?:[.-]\w+)*", t)] for n, t in TEMPLATES if n == r["license"]]
        starts = len(re.findall(r"\w+(?:[.-]\w+)*", docs[r["doc_id"]].split("\n")[r["line"]]))
        assert any(in_order(w, text[: starts + 2 * len(w) + 16]) >= 0.8 * len(w) for w in wordings), r


def test_ties():
    same = [("A", "All rights reserved by nobody."), ("B", "All rights reserved by nobody.")]
    assert [r[1] for r in Scanner(same).scan("All rights reserved by nobody.")] == ["A"]
    assert [r[1] for r in Scanner(same[::-1]).scan("All rights reserved by nobody.")] == ["B"]


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "x\nReleased under the MIT License.\n" + "y " * 100000), (3, "Released under the MIT License."), (None, "All rights reserved.")]
    got = sorted((r["doc_id"] or 0, r["line"], r["license"]) for r in scan(cases.table(spark, rows)).collect())
    assert got == [(0, 0, "Proprietary"), (3, 0, "MIT"), (3, 1, "MIT")]
    assert scan(cases.empty(spark)).count() == 0


def test_notices_inside_long_lines(spark):
    texts = [" ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    texts = [t for t in texts if len(t) > 3500 and not re.search(CANDIDATE, t)][:3]
    s = Scanner()
    assert texts
    for t in texts:
        for name, text in TEMPLATES:
            assert [r[:2] + r[4:] for r in s.scan(f"{t} {text} {t}")] == [(0, name, [], [])]
        found = s.scan(f"{t} This work is kindly licensed under the GNU General Public License, version 3 {t}")
        assert [(r[1], r[4], r[5]) for r in found] == [("GPL-3.0", [], ["kindly"])]


def test_notices_across_lines():
    s = Scanner()
    for name, text in TEMPLATES:
        for width in (20, 45, 72):
            for mark in ("", "# ", " * ", "// "):
                wrapped = "\n".join(mark + line for line in textwrap.wrap(text, width, break_on_hyphens=False))
                assert [r[:2] + r[4:] for r in s.scan(f"import this\n{wrapped}\n\nprint(1)")] == [(1, name, [], [])], (name, width, mark)


def test_every_notice_of_a_line():
    line = "Released under the MIT License. Licensed under CC BY 4.0. All rights reserved. All rights reserved."
    assert [r[1] for r in Scanner().scan(line)] == ["MIT", "CC-BY-4.0", "Proprietary", "Proprietary"]
    every = list(Scanner().scan(" ".join(t for _, t in TEMPLATES)))
    assert [(r[1], r[4], r[5]) for r in every] == [(n, [], []) for n, _ in TEMPLATES]


def test_own_templates(spark):
    own = [("Beer", "As long as you retain this notice you can do whatever you want with this stuff."), ("Été", "Usage Élargi")]
    rows = [(1, "x\n# As long as you retain this\n# notice you may do whatever you want with this stuff."), (2, "Released under the MIT License."), (3, "usage élargi")]
    got = sorted((r["doc_id"], r["line"], r["license"], r["missing"], r["added"]) for r in scan(cases.table(spark, rows), own).collect())
    assert got == [(1, 1, "Beer", ["can"], ["may"]), (3, 0, "Été", [], [])]
    wrapped = cases.table(spark, [(4, "Copyright nobody.\nAll rights\n reserved."), (5, "All rights\nreserved")])
    assert sorted((r["doc_id"], r["line"], r["license"]) for r in scan(wrapped).collect()) == [(4, 1, "Proprietary"), (5, 0, "Proprietary")]
