"""Inputs at the open ends of operators 3 and 6 and of the pipeline: nothing is cut, nothing that is hidden comes out."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import html_text, pii


def mod97(account):
    account = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


CHANGED = {
    "a@b.c.d.e.f.g.h.i.j.example.com": r"u[0-9a-f]{16}@mail\.invalid", "l" * 80 + "@x.org": r"u[0-9a-f]{16}@mail\.invalid", "password: hunter2": r"password: [0-9a-f]{7}",
    "DE89 3704 0044 0532 0130 00": r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", "GB82WEST12345698765432": r"GB\d\dWEST\d{14}", "07700 900123": r"0\d{4} \d{6}", "020 7946 0958": r"0\d\d \d{4} \d{4}",
    "3/5/2024": r"\d{1,2}/\d{1,2}/\d{4}", "3/25/2024": r"\d{1,2}/\d{1,2}/\d{4}", "3.5.2024": r"\d{1,2}\.\d{1,2}\.\d{4}", "fe80::1ff:fe23:4567:890a": r"2001:db8(:[0-9a-f]{4}){6}", "2001:0db8:85a3:0000:0000:8a2e:0370:7334": r"2001:db8(:[0-9a-f]{4}){6}",
    "ghp_abcdefghijklmnopqrstuvwxyz0123456789": r"ghp_[0-9a-f]{36}",
}
KEPT = ["DE89 3704 0044 0532 0130 01", "std::vector a::b 12:30:45", "31/31/2024", "v 1.2.3 p. 10/12"]


def test_kinds_of_private_values(spark):
    texts = [*CHANGED, *KEPT]
    frame = spark.createDataFrame([(t, f"see {t} here and {t}.") for t in texts], "t string, text string").coalesce(1)
    got = {r["t"]: r["text"] for r in pii.pseudonymise(frame).collect()}
    for t, pattern in CHANGED.items():
        m = re.fullmatch(rf"see ({pattern}) here and (\1)\.", got[t])
        assert m and m[1] != t, (t, got[t])
        if mod97(t) == 1 if re.match(r"[A-Z]{2}\d\d", t) else False:
            assert mod97(m[1]) == 1
    assert all(got[t] == f"see {t} here and {t}." for t in KEPT)
    dates = spark.range(3000).select(F.date_format(F.expr("date_add(date'1990-01-01', cast(id as int))"), "d/M/yyyy").alias("text")).coalesce(2)
    assert pii.pseudonymise(dates).select("text").distinct().count() == 3000


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<style>" + ".q," * 1500 + ".x{display:none}</style><p class=x>HID<p>ok", "ok"),
        ("<style>@media print{.a{display:none}} .b{display:none}</style><p class=a>A<p class=b>B", "A"),
        ("<style>@media (max-width:600px){.a{display:none}} @media screen and (min-width:700px){.b{display:none}}</style><p class=a>A<p class=b>B", "A"),
        ("<style>div.d{display:none} #g.h{display:none} p{content:'}'} .e .f{display:none}</style><div class=d>D</div><p class=d>P<p id=g class='h z'>G<p class=f>F", "P\n\nF"),
        ("<ol reversed><li>a<li>b<li value=9>c<li>d</ol>", "4. a\n3. b\n9. c\n8. d"),
        ("<table><tr><td>" + "word " * 20 + "<td>right<tr><td>s<td>t</table>", "word " * 12 + "word  right\n" + "word " * 6 + "word\ns" + " " * 65 + "t"),
    ],
)
def test_style_sheets_lists_and_long_cells(source, text):
    assert html_text.render(source) == text


def test_the_first_stage_keeps_columns_of_any_name(spark):
    rows = [(i, f"the words of this sentence are plain number {i} and so is the rest of it", "en", "mine", 0.5, "x") for i in range(30)] + [(90, None, "en", "mine", 0.5, "x"), (91, "12 34", "en", "mine", 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _corvane_lang string, _corvane_score double, _corvane_lang_ string")
    got = corpus_pipeline.language(spark, docs, "").collect()
    assert len(got) == 30 and got[0].asDict().keys() == set(docs.columns) and {(r["_corvane_lang"], r["_corvane_score"]) for r in got} == {("mine", 0.5)}
