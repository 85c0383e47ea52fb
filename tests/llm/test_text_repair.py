import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import languages, mojibake, scanlines, scans, splitting
from foliospark.llm.boosting import Boosting
from foliospark.llm.bytecnn import ByteCnn

WORDS = {
    "eng": "the report shows that every signed document was checked before the meeting and nobody has asked for another change in that office",
    "deu": "der Bericht zeigt dass jedes geprüfte Dokument vor der Sitzung geändert wurde und niemand hat sich über diese Prüfung gemeldet",
    "fra": "le rapport montre que chaque pièce signée était vérifiée avant la réunion et personne n’a demandé une autre procédure numérisée",
    "rus": "важный отчёт показывает что каждый подписанный документ проверяли до встречи и никто не просил другой перечень",
}


def sentence(code, rng, n=12):
    return " ".join(rng.choices(WORDS[code].split(), k=n)).capitalize() + "."


def text(code, rng, n=8):
    return " ".join(sentence(code, rng) for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n,c中é́", max_size=400), st.integers(1, 80), st.integers(0, 79))
def test_split(t, limit, overlap):
    if overlap >= limit:
        return
    p = splitting.split(t, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(t) and all(b - a <= limit for a, b, _ in p)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(p, p[1:], strict=False))


def test_split_prefers_topics(spark):
    rng = random.Random(0)
    a = " ".join("Cats eat fish and cats sleep." for _ in range(6))
    b = " ".join("Stocks and bonds gain value." for _ in range(6))
    pieces = splitting.split(f"{a} {b}", 250, 0)
    assert pieces[0][1] == len(a) + 1 and pieces[0][2] == "topic"
    conf = spark.createDataFrame([(1, 100, 10, True, "text"), (2, 5, 9, False, "text")], "config_id int, max_characters int, overlap int, trim_pieces boolean, chunker_type string")
    long = text("eng", rng)
    rows = [(1, 1, long, "x"), (1, 1, long, "x"), (2, 1, None, "x"), (3, 1, "", "x"), (4, 1, " " * 200, "x"), (5, 7, long, "x"), (6, 2, "abcdefgh", "x"), (None, 1, long, "x"), (7, 1, "y" * 100_000, "x")]
    df = spark.createDataFrame(rows, "chunk_id bigint, config_id int, content string, overlap string")
    assert sorted(r[0] for r in splitting.found(df, conf).collect()) == [1, 6, 7]
    out = splitting.oversized_pieces(df, conf).where("chunk_id = 1").collect()
    assert all(len(r["content"]) <= 100 for r in out)
    wrong = splitting.oversized_pieces(df, conf).where("chunk_id = 6").collect()  # the overlap is not below the limit
    assert [(r["boundary"], r["content"]) for r in wrong] == [("error", "abcdefgh")]
    assert splitting.found(df.limit(0), conf).count() == 0


def test_network_learns():
    rng = random.Random(1)
    units = languages.Units([text(c, rng, 300) for c in WORDS])
    windows, first = units.windows()
    labels = units.doc[np.searchsorted(first, np.arange(len(windows)), side="right") - 1]
    model = ByteCnn(4).fit(windows[::2], labels[::2], epochs=12)
    right = model.log_probabilities(windows[1::2]).argmax(1) == labels[1::2]
    assert right.mean() > 0.95  # held out


def test_languages(spark):
    rng = random.Random(2)
    rows = [(k, text(c, rng), (c,)) for k, c in enumerate([*WORDS] * 25)]
    rows += [(1000, text("eng", rng), (None,)), (1001, text("deu", rng), ("fra",)), (1002, text("eng", rng, 10) + " " + text("deu", rng, 4), ("eng",)), (1003, text("eng", rng) + " Jedes Dokument. " + text("eng", rng), ("EN-gb",))]
    rows += [(1004, None, ("eng",)), (1005, "", (None,)), (1006, "short", (None,)), (1007, "12 34 " * 40, (None,)), (1002, rows[102][1], ("eng",)), (None, text("fra", rng), ("fra",))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "extraction_id bigint, content string, metadata struct<language: string>, label int")
    got = sorted(map(tuple, languages.found(df).collect()))
    assert got == [(1000, "eng"), (1001, "deu"), (1002, "deu"), (1002, "eng")]
    seg = languages.language_segments(df, model=languages.fit(df, df["content"], df["metadata"]["language"], df["extraction_id"])).where("id = 1002 AND counts").collect()
    assert {r["lang"] for r in seg} == {"eng", "deu"} and all(0 < r["confidence"] <= 1 for r in seg)
    assert languages.found(df.limit(0)).count() == 0


def test_garbling_round_trips():
    for word in ("geprüft", "numérisée", "важный", "późniejszy", "完整", "—"):
        for form, chain in mojibake.forms(word).items():
            if chain != "lossy":
                assert mojibake.restore(form, chain) == word


def test_garbled(spark):
    rng = random.Random(3)
    clean = [(k, text(c, rng), 1) for k, c in enumerate([*WORDS] * 15)]
    chains = ["utf-8>cp1252", "utf-8>cp1252>utf-8>cp1252", "utf-8>cp437", "utf-8>mac_roman"]
    bad = {500 + k: text("deu" if k % 2 else "fra", rng) for k in range(4)} | {510: text("rus", rng)}
    rows = clean + [(k, mojibake.garble(t, chains[k - 500] if k < 510 else "koi8-r>cp1251"), 1) for k, t in bad.items()]
    rows += [(520, bad[501].replace("ü", "�"), 1), (521, "├── file.txt\nNÃO", 1), (522, None, 1), (523, "", 1), (524, "plain", 1), (500, rows[60][1], 2), (None, rows[60][1], 2)]
    df = spark.createDataFrame(rows, "extraction_id bigint, content string, token int")
    assert sorted(r[0] for r in mojibake.found(df).collect()) == [*bad, 520]
    back = {r["id"]: r["content"] for r in mojibake.Garbled(df).repaired().collect()}
    assert all(back[k] == t for k, t in bad.items())
    assert mojibake.found(df.limit(0)).count() == 0


def test_garbled_latin_words_that_stand_nowhere_else(spark):
    clean = [(k, f"“Word{k}” was the title – “Other{k}” and “Third{k}” are wênt wêll, l’été mot—était événement révision créée 不是 完整 ю ю{k} дом") for k in range(5)]
    rows = [*clean, (100, "ΓÇ£TevbelusaΓÇ¥ was it"), (101, "then mÃªler only"), (102, "“Nothing” mot—étais évènementiel créées ici")]
    df = spark.createDataFrame(rows, "extraction_id bigint, content string")
    assert sorted(r[0] for r in mojibake.found(df).collect()) == [100, 101]
    back = {r["id"]: r["content"] for r in mojibake.Garbled(df).repaired().collect()}
    assert back == {100: "“Tevbelusa” was it", 101: "then mêler only"}


def test_garbled_text_in_character_references(spark):
    clean = [(k, f"Der geprüfte Ausdruck Nr. {k} – schéma récent") for k in range(6)] + [(20, "Der gepr&#252;fte &amp; R&D &copy; &lt;b&gt; AT&T; &nosuch; &#1114112; &#55300;")]
    rows = [*clean, (100, "Der gepr&#195;&#188;fte Ausdruck"), (101, "le sch&Atilde;&copy;ma"), (102, "ein m&#xC3;&#xBC;der Fall")]
    op = mojibake.Garbled(spark.createDataFrame(rows, "extraction_id bigint, content string"))
    assert sorted(r[0] for r in op.affected().collect()) == [100, 101, 102]
    assert {r["id"]: r["content"] for r in op.repaired().collect()} == {100: "Der geprüfte Ausdruck", 101: "le schéma", 102: "ein müder Fall"}


def test_garbled_words_are_no_originals(spark):
    clean = [(k, f"a — b {k} costs € {k}") for k in range(9)] + [(20, "naïf cité"), (21, "naïf cité")]
    bad = [(100 + k, mojibake.garble("a — b € c", "utf-8>cp1252")) for k in range(3)] + [(110, mojibake.garble("a — b", "utf-8>mac_roman")), (111, mojibake.garble("a € b", "utf-8>latin-1"))]
    # 20 and 21 are clean, though their words are what a decoding makes of the garbled ones
    bad += [(120 + k, mojibake.garble("naïf cité", "utf-8>cp1252")) for k in range(3)]
    df = spark.createDataFrame([*clean, *bad], "extraction_id bigint, content string")
    op = mojibake.Garbled(df)
    assert sorted(r[0] for r in op.affected().collect()) == [r[0] for r in bad]
    assert {r["id"]: r["content"] for r in op.repaired().where("id IN (110, 111)").collect()} == {110: "a — b", 111: "a € b"}
    assert all("�" in f for f, c in mojibake.forms("Ã©").items() if c == "lossy")


def test_forms_of_words_of_one_record(spark):
    words = ["подписанный", "документ", "проверяли", "перечень", "встречи"]
    other = "важный отчёт показывает что каждый никто не просил другой до новый список договор таблица страница ключ шум цена щит фильм эхо съезд юг"
    rows = [(k, other) for k in range(8)] + [(20 + k, w) for k, w in enumerate(words)] + [(40, mojibake.garble(" ".join(words), "koi8-r>cp1251"))]
    rows += [(50, "слово" * 20 + " end"), (51, mojibake.garble("слово" * 20 + " end", "koi8-r>cp1251"))]
    op = mojibake.Garbled(spark.createDataFrame(rows, "extraction_id bigint, content string"))
    assert [r[0] for r in op.affected().collect()] == [40]
    assert op.repaired().first()["content"] == " ".join(words)
    assert mojibake.restore(rows[-1][1].split()[0], "koi8-r>cp1251") in {r["word"] for r in op.table.where("word IS NOT NULL").collect()}


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    m = Boosting(60).fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


def test_number_lines():
    assert [scanlines.number_of(s) for s in ("- 44 -", "Page 3 of 9", "xiv", "– l3 –", "12/15", "Seite 7", "text", "3 apples")] == [44, 3, 14, 13, 12, 7, None, None]


def test_furniture_on_held_out_scans():
    rng = random.Random(4)
    texts = [text(c, rng, 60) for c in WORDS for _ in range(30)]
    models = scanlines.fit_furniture(texts[::2])
    hit = miss = wrong = 0
    for t in texts[1::2]:
        content, running, numbers = scanlines.made_up_scan(t, rng)
        a, b = scanlines.furniture(scanlines.Page(content), *models)
        hit += len(a & running) + len(b & numbers)
        miss += len(running - a) + len(numbers - b)
        wrong += len(a - running) + len(b - numbers)
    assert hit / (hit + miss) > 0.9 and hit / (hit + wrong) > 0.9


def test_high_headers_and_far_pages():
    rng = random.Random(6)
    models = scanlines.fit_furniture([text(c, rng, 60) for c in WORDS for _ in range(15)])
    head = ["Annual Report of the Office", "Department of Records", "Northern Division", "Volume Three", "Confidential Copy"]
    body = lambda: [sentence("eng", rng, 8) for _ in range(16)]
    pages = [[*head, *body(), f"{'—' * 14} {n} {'—' * 14}"] for n in range(1, 5)]
    page = scanlines.Page("\n\f\n".join("\n".join(p) for p in pages))
    running, numbers = scanlines.furniture(page, *models)
    starts = [k for k, x in enumerate(page.lines) if x == head[0]]
    assert {k + j for k in starts for j in range(5)} <= running
    assert numbers == {k for k, x in enumerate(page.lines) if x.startswith("——")}
    # the same header, but misread on a page that is far from all others that have one
    pages = [[*(["Annual Report of the Office"] if n < 4 else ["Annua1 Report of thc Office"] if n == 12 else []), *body()] for n in range(1, 14)]
    page = scanlines.Page("\n\f\n".join("\n".join(p) for p in pages))
    running, _ = scanlines.furniture(page, *models)
    assert page.lines.index("Annua1 Report of thc Office") in running


def test_words_that_are_checked():
    assert scans.checked_words("REP0RT") == ["rep0rt"] and scans.checked_words("0f") == ["0f"] and scans.checked_words("sig-ned") == ["sig", "ned"]
    assert not any(map(scans.checked_words, ("REPORT", "of", "A4", "TH-123", "12", "中文", "", "UNO", "3D")))
    assert scans.reading_cost("donaudampfschifffahrtsgesellschaft" * 3, "d0naudampfschifffahrtsgesellschaft" * 3) == pytest.approx(0.9)


def test_scans(spark):
    rng = random.Random(5)
    clean = [(k, text("eng", rng, 12), ("text",)) for k in range(60)]
    fill = lambda: [sentence("eng", rng, 9)[:-1] for _ in range(5)]
    body = ["The report shows that every sig-", "ned document was cbecked before", "the rneeting and nobody has asked"]
    pages = [[head, *fill(), *body, *fill(), f"- {n} -"] for head, n in (("Quarterly summary", 7), ("Quarterly sumrnary", 8), ("Quarterly summary", 9))]
    scan = "\n\f\n".join("\n".join(p) for p in pages)
    rows = [*clean, (100, scan, ("ocr",)), (100, scan, ("ocr",)), (101, None, ("ocr",)), (102, "", ("ocr",)), (103, "word", ("ocr",)), (None, scan, ("ocr",)), (104, "x" * 50_000, ("ocr",))]
    df = spark.createDataFrame([(*r, 3) for r in rows], "extraction_id bigint, content string, metadata struct<format_type: string>, line int")
    op = scans.Scans(df)
    got = {(r["line_no"], r["defect"]) for r in op.defects().where("id = 100").collect()}
    want = {(ln + o, d) for ln in (1, 17, 33) for o, d in ((0, "running_line"), (6, "hyphen_break"), (7, "misread_word"), (8, "misread_word"), (14, "page_number"))}
    assert got == want
    fixed = op.repaired().where("id = 100").first()["content"]
    assert "every signed document was checked before the meeting" in fixed and "Quarterly" not in fixed and "- 8 -" not in fixed
    assert scans.found(df.limit(0)).count() == 0
