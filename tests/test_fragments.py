import re

from millrace.operators.fragments import fragments, split_elements

TABLE = "<table><thead><tr><th>h</th></tr></thead><tbody>" + "".join(f"<tr><td>r{i}</td></tr>" for i in range(9)) + "</tbody></table>"


def test_tables_repeat_their_header_and_lose_no_row():
    for budget in (60, 120, 200):
        parts = fragments(TABLE, len, budget)
        assert re.findall(r"r\d", "".join(parts)) == [f"r{i}" for i in range(9)]
        assert len(parts) > 1 and all("<th>h</th>" in p and (len(p) <= budget or p.count("<td>") == 1) for p in parts)
    assert fragments(TABLE, len, 10_000) == [TABLE]


def test_lists_go_on_counting():
    parts = fragments("<ol start=3>" + "<li>item</li>" * 5 + "</ol>", len, 50)
    assert [m[0] for p in parts if (m := re.findall(r'start="(\d+)"', p))] == ["3", "5", "7"] and "".join(parts).count("item") == 5
    dl = fragments("<dl><dt>a<dd>b</dl>".replace("<dd>", "</dt><dd>").replace("</dl>", "</dd><dt>c</dt><dd>d</dd></dl>"), len, 40)
    assert dl == ["<dl><dt>a</dt><dd>b</dd></dl>", "<dl><dt>c</dt><dd>d</dd></dl>"]
    assert fragments("plain text", len, 3) == ["plain text"] and fragments("<p>long text</p>", len, 3) == ["<p>long text</p>"]


def test_elements(spark):
    df = spark.createDataFrame([(1, 0, TABLE), (1, 1, "<p>x</p>"), (1, 2, None)], "doc_id int, pos int, html string")
    rows = [(r.pos, r.fragment) for r in split_elements(df, 4).orderBy("pos", "fragment").collect()]
    assert rows == [(0, 0), (0, 1), (0, 2), (1, 0)]
