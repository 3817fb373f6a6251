import pytest

from tests.llm.fresh_names import FRESH, FRESH_NONE
from tracewake.llm import names, pii, surrogates

LEX = [("Marla", "given", "latin"), ("Petra", "given", "latin"), ("Arkwell", "family", "latin"), ("Ostergaard-Lim", "family", "latin"), ("南", "family", "zh"), ("沐", "family", "zh"), ("芷", "given", "zh"), ("岚", "given", "zh")]
TAGGER = names.train(LEX, [], [], 1)


def of(text):
    return [(k, text[a:b]) for a, b, k in pii.mentions(text, TAGGER)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to zelda_quen5@corp.example.com.", [("email", "zelda_quen5@corp.example.com")]),
        ("cc katia.f at mail dot bright dot example, x", [("email", "katia.f at mail dot bright dot example")]),
        ("mail zelda29 [at] corp [dot] example [dot] com now", [("email", "zelda29 [at] corp [dot] example [dot] com")]),
        ("邮箱calixto_h95＠fernpost.example。", [("email", "calixto_h95＠fernpost.example")]),
        ("<a+b(at)ops.field.test>", [("email", "a+b(at)ops.field.test")]),
        ("Clone git@git.north.example:x.git and ssh://deploy@svc.north.example:8420/p, build@runner4:/var kit@0.22.5", []),
        ("lines\n@app.post and 871\n@app.get", []),
        ("call (+1 253 555 0137), or (439) 555-0134", [("phone", "+1 253 555 0137"), ("phone", "(439) 555-0134")]),
        ("text 819.555.0151 or 07700 900802 or +44 7700 900514", [("phone", "819.555.0151"), ("phone", "07700 900802"), ("phone", "+44 7700 900514")]),
        ("an +49 (0)30 23125543 oder 0049 30 23125179 oder 030/23125-639", [("phone", "+49 (0)30 23125543"), ("phone", "0049 30 23125179"), ("phone", "030/23125-639")]),
        ("Llamar al +34 585 716 245 o tel. 547 73 32 69, tel. 567.477.401.", [("phone", "+34 585 716 245"), ("phone", "547 73 32 69"), ("phone", "567.477.401")]),
        ("电话+86 102 1398 7000，联系方式 102-7725-5386，致电 10246204109", [("phone", "+86 102 1398 7000"), ("phone", "102-7725-5386"), ("phone", "10246204109")]),
        ("nobody answered 14345550153. Epoch 1773848085, lines 3478-1727, node 10.15.88.75, Build 20241113-3332", [("phone", "14345550153")]),
        ('user_phone="4325550160" crew=30, phone: 19235550141; id=4325550160', [("phone", "4325550160"), ("phone", "19235550141")]),
        ("SSN 979 79 5073 and tax id QQ 51 41 54 A, QQ998995A, DNI 90005865B o 90008807-D", [("id_number", x) for x in ("979 79 5073", "QQ 51 41 54 A", "QQ998995A", "90005865B", "90008807-D")]),
        ("身份证号 998965196503048040，Ausweisnummer XGWC66233, order 123456789012345678", [("id_number", "998965196503048040"), ("id_number", "XGWC66233")]),
        ("at 165B Cobbler Avenue. Or 299B Juniper Bend St. | now", [("address", "165B Cobbler Avenue"), ("address", "299B Juniper Bend St.")]),
        ("an Webereistr. 401a, Lindwurmweg 753a", [("address", "Webereistr. 401a"), ("address", "Lindwurmweg 753a")]),
        ("y C/ Fuente Honda, 58 y Calle de la Cantera 503", [("address", "C/ Fuente Honda, 58"), ("address", "Calle de la Cantera 503")]),
        ("请把测试机寄到石桥路 936号，快递已送到望湖巷165 号", [("address", "石桥路 936号"), ("address", "望湖巷165 号")]),
        ("Author: Karen Quorn. Thanks Viggo, merged. Ask in the Arkwell Gateway channel. The Marla service", [("name", "Karen Quorn")]),
        ("by MARLA OSTERGAARD-LIM and P. Arkwell or Zed K. Arkwell; Arkwell, Marla", [("name", "MARLA OSTERGAARD-LIM"), ("name", "P. Arkwell"), ("name", "Zed K. Arkwell"), ("name", "Arkwell, Marla")]),
        ("Dr. Petra Quenneth approved OPS-1", [("name", "Petra Quenneth")]),
        ("负责人：卞秋雨，电话；状态由 PolicyStore 统一维护", [("name", "卞秋雨")]),
        ("由Petra Nussdorfer提交；见 南芷岚，单号", [("name", "Petra Nussdorfer"), ("name", "南芷岚")]),
        ("Ring 020 7946 0958 or (0161) 496 0734 or 01632 960983", [("phone", x) for x in ("020 7946 0958", "(0161) 496 0734", "01632 960983")]),
        ("(02) 5550 4321, 0491 570 156, +61 2 5550 4321; (07700 900802)", [("phone", x) for x in ("(02) 5550 4321", "0491 570 156", "+61 2 5550 4321", "07700 900802")]),
        ("01 99 00 12 34, Tel. 089/12345678, 010-8765 4321", [("phone", x) for x in ("01 99 00 12 34", "089/12345678", "010-8765 4321")]),
        ("415-555-0100 / 415-555-0101 and 2024-03-01 10.0.0.1 415-555-0100 x", [("phone", x) for x in ("415-555-0100", "415-555-0101", "415-555-0100")]),
        ("1600 Pennsylvania Avenue NW, 350 5th Avenue, 17 Elm Grove", [("address", x) for x in ("1600 Pennsylvania Avenue NW", "350 5th Avenue", "17 Elm Grove")]),
        ("Karl-Marx-Straße 12, Unter den Linden 77, Gran Vía 32", [("address", x) for x in ("Karl-Marx-Straße 12", "Unter den Linden 77", "Gran Vía 32")]),
        ("北京市朝阳区建国路88号，上海市南京东路100号", [("address", "建国路88号"), ("address", "南京东路100号")]),
        ("", []),
    ],
)
def test_mentions(text, want):
    assert of(text) == want


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, kind string, value string")


def lexicon(spark, rows=LEX):
    return spark.createDataFrame(rows, "name string, name_part string, script string")


ROWS = [
    (1, "Signed-off-by: Petra Arkwell\nmail p.a@corp.example or P.A@CORP.EXAMPLE, again p.a@corp.example. Arkwell, Petra"),
    (2, None),
    (3, ""),
    (None, "p.a@corp.example"),
    (4, "nothing here"),
    (5, "x " * 300_000 + "call +1 253 555 0137"),
    (6, "Dr. Xyla Quorn approved OPS-1, call 253-555-0137, SSN 979-79-5073, 石桥路 936号, 负责人：卞秋雨。"),
]


def test_found_and_redacted(spark):
    got = {tuple(r) for r in pii.find(frame(spark, ROWS), lexicon(spark)).collect()}
    assert {(1, "email", "p.a@corp.example"), (1, "email", "P.A@CORP.EXAMPLE"), (1, "name", "Petra Arkwell"), (1, "name", "Arkwell, Petra"), (5, "phone", "+1 253 555 0137")} <= got
    assert {r[0] for r in got} == {1, 5, 6} and len(got) == 10
    red = {r.doc_id: r for r in pii.redacted(frame(spark, ROWS), lexicon(spark)).collect()}
    assert red[1].redacted == "Signed-off-by: [NAME_1]\nmail [EMAIL_1] or [EMAIL_1], again [EMAIL_1]. [NAME_1]" and red[1].mentions == 5
    assert red[2].redacted is None and red[3].redacted == "" and red[4].redacted == "nothing here" and len(red) == 6
    assert pii.find(frame(spark, []), lexicon(spark)).count() == 0
    assert pii.find(frame(spark, ROWS), lexicon(spark, [])).where("doc_id = 1 AND kind = 'email'").count() == 2


DEVELOPMENT = [
    ("Minutes taken by Tobias Ferncastle on the second floor", ["Tobias Ferncastle"]), ("Reviewed the draft with Marguerite Dubarry last night.", ["Marguerite Dubarry"]),
    ("Please forward this letter to Callum Strachan before noon.", ["Callum Strachan"]), ("The violin belongs to Eszter Halmos.", ["Eszter Halmos"]),
    ("Invoice 77 was paid by Rutger Hazelhoff in March.", ["Rutger Hazelhoff"]), ("As Philippa Greaves pointed out, the lid was open.", ["Philippa Greaves"]),
    ("Kowalski, Zbigniew has the keys.", ["Kowalski, Zbigniew"]), ("Applicant: Oluwaseun Adeyemi", ["Oluwaseun Adeyemi"]), ("witnessed by J. Haverford and two others", ["J. Haverford"]),
    ("Ms. Winifred Oakhurst rang twice.", ["Winifred Oakhurst"]), ("tenant=Bartholomew Crane; flat=3", ["Bartholomew Crane"]), ("Das Paket hat Annelie Kirchgässner angenommen.", ["Annelie Kirchgässner"]),
    ("Frau Roswitha Ebersbach möchte kündigen.", ["Roswitha Ebersbach"]), ("Herr Dr. Gernot Wiesinger kommt später.", ["Gernot Wiesinger"]), ("Firma verlassen: Detlef Kranz", ["Detlef Kranz"]),
    ("Ha llamado Almudena Rocafort por la factura.", ["Almudena Rocafort"]), ("El paquete lo firmó Ramiro Etxeberria.", ["Ramiro Etxeberria"]), ("Señora Consuelo Barrientos, piso tercero", ["Consuelo Barrientos"]),
    ("Atentamente,\nNicanor Villalobos", ["Nicanor Villalobos"]), ("> On Friday Sven Lindqvist wrote:", ["Sven Lindqvist"]), ("GEORGINA FAIRWEATHER signed the form.", ["GEORGINA FAIRWEATHER"]),
    ("Our accountant, Desmond P. Abernathy, retired.", ["Desmond P. Abernathy"]), ("to be signed by Imogen Thackeray and Rufus Pemberton", ["Imogen Thackeray", "Rufus Pemberton"]),
    ("I had lunch with Ines Varga on Tuesday.", ["Ines Varga"]), ("Passenger: Nakamura, Aiko", ["Nakamura, Aiko"]), ("assignee = Tomasz Wieczorek", ["Tomasz Wieczorek"]), ("Prof. Amara Okafor lectures here.", ["Amara Okafor"]),
    ("房东陈建国不同意", ["陈建国"]), ("请把合同交给刘雨欣签字", ["刘雨欣"]), ("王志强昨天来过", ["王志强"]), ("老师周晓琳教数学", ["周晓琳"]), ("这把钥匙属于孙浩然。", ["孙浩然"]), ("吴海涛先生的快递", ["吴海涛"]), ("投诉人：郑美玲", ["郑美玲"]), ("已通知徐立新到场", ["徐立新"]),
]
NO_NAMES = [
    "The Golden Hour begins in Central Park.", "Visual Basic and Power Query are old.", "See Appendix B for the Final Report.", "Der Bahnhof Friedrichstraße ist gesperrt.", "Die Neue Version enthält Fehler.", "El Banco Central subió los tipos.", "Happy New Year to the Sales Team!", "Great Wall of China",
    "Error Code 5 in Boot Loader", "Black Friday at Union Square", "这个方法需要重写", "任务已经完成", "周期太长", "请检查程序是否成功启动", "高级用户可以导出文件", "时间和金额都不对", "Machine Learning Engineers wanted", "Load Balancer restarted",
]


def test_names_on_development_sentences():
    """No table holds these, but the tagger's lists and made-up sentences were adjusted while looking at them: see the next test."""
    plain = names.train([], [], [], 1)
    spans = [({t[a:b] for a, b in plain.names(t)}, set(w)) for t, w in DEVELOPMENT]
    hits, wanted, found = sum(len(g & w) for g, w in spans), sum(len(w) for _, w in spans), sum(len(g) for g, _ in spans)
    assert hits / wanted >= 0.9 and hits / found >= 0.9
    assert sum(len(plain.names(t)) for t in NO_NAMES) <= 1


def test_names_on_sentences_scored_blind():
    """Measured once, without later changes to the tagger: 26 of 31 names, 7 spans in the 15 sentences without names."""
    plain = names.train([], [], [], 1)
    hits = sum(len({t[a:b] for a, b in plain.names(t)} & set(w)) for t, w in FRESH)
    assert hits / sum(len(w) for _, w in FRESH) >= 0.8
    assert sum(len(plain.names(t)) for t in FRESH_NONE) <= 7


def test_tagger_learns_from_the_corpus():
    """Contexts and name parts of the sample carry over to names that no list holds."""
    given, family = "Quillon Xanthe Osric Viggo Fenna Hesper".split(), "Vanterpool Dravenholt Lathbury Kirrowell Mornvale Gallenby".split()
    lex = [*((g, "given", "latin") for g in given), *((f, "family", "latin") for f in family)]
    records = [r for g in given for f in family for *_, r in names.latin_candidates(f"widget handed to {g} {f} // ok")]
    text = "widget handed to Zarvo Ullmbrix // ok"
    without, tagger = names.train(lex, [], [], 1), names.train(lex, records, [("widget", 99), ("handed", 99)], 36)
    (_, _, r), = names.latin_candidates(text)
    assert tagger.score(r) > without.score(r) and [text[a:b] for a, b in tagger.names(text)] == ["Zarvo Ullmbrix"]


def shape(s):
    return "".join("0" if c.isdigit() else "" if c.isalpha() else c for c in s)


def test_surrogates_corefer_and_stay_distinct(spark):
    docs = [*ROWS, *[(100 + i, f"Author: Karen {f}. Call +1 253 555 {1000 + i} or u{i}@corp.example") for i, f in enumerate(w.title() for w in names.FAMILY[:26])]]
    docs += [(300, "Author: Jane Doe, cc: J. Doe; from Jane Q. Doe\nTel. +44 7700 900514 or 07700 900514")]
    rows = {r.doc_id: r for r in pii.with_surrogates(frame(spark, docs), lexicon(spark), b"key").collect()}
    out = {i: r.text for i, r in rows.items()}
    assert out[2] is None and out[3] == "" and out[4] == "nothing here"
    swaps = {x["value"]: x["surrogate"] for x in rows[300].replaced}
    assert {"Jane Doe", "J. Doe", "Jane Q. Doe", "+44 7700 900514", "07700 900514"} == set(swaps)
    given, family = swaps["Jane Doe"].split()
    assert swaps["J. Doe"] == f"{given[0]}. {family}" and swaps["Jane Q. Doe"].split()[::2] == [given, family] and "Q." not in swaps["Jane Q. Doe"]
    assert swaps["+44 7700 900514"][4:] == swaps["07700 900514"][1:] and swaps["+44 7700 900514"].startswith("+44 ")
    names1 = {x["value"]: x["surrogate"] for x in rows[1].replaced}
    assert names1["Arkwell, Petra"].split(", ")[::-1] == names1["Petra Arkwell"].split() and "Arkwell" not in out[1]
    assert names1["p.a@corp.example"].upper() == names1["P.A@CORP.EXAMPLE"]
    assert len({out[100 + i].split(". Call")[0] for i in range(26)}) == 26
    assert {x["value"]: x["surrogate"] for x in rows[6].replaced}["253-555-0137"] == {x["value"]: x["surrogate"] for x in rows[5].replaced}["+1 253 555 0137"][3:].replace(" ", "-")
    again, other = ({r.doc_id: r.text for r in pii.with_surrogates(frame(spark, docs), lexicon(spark), k).collect()} for k in (b"key", b"other"))
    assert again == out and other[6] != out[6]
    listed = {(r.doc_id, r.kind, r.value) for r in pii.replacements(frame(spark, docs), lexicon(spark), b"key").collect()}
    assert {(i, x["value"]) for i, r in rows.items() for x in r.replaced} == {(i, v) for i, _, v in listed}


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ZH_FAMILY", "aA")
    monkeypatch.setattr(surrogates, "ZH_GIVEN", "bB")
    parts = spark.createDataFrame([("name", v) for v in ("南芷", "沐芷", "南岚", "沐岚", "弋秋", "卞秋", "祁舟", "郗舟", "祁秋", "弋芷")], "part string, entity string")
    table = surrogates.surrogate_table(parts, b"k").collect()
    assert len(table) == 10 and len({r.surrogate for r in table}) == 10 and all(len(r.surrogate) == 2 for r in table)
    many = spark.range(6000).selectExpr("'family' AS part", "concat('n', id) AS entity")
    drawn = surrogates.surrogate_table(many, b"k").collect()
    assert len({r.surrogate for r in drawn}) == 6000 and all(r.surrogate.isalpha() for r in drawn)


@pytest.mark.parametrize(("kind", "value"), [("phone", "(439) 555-0134"), ("phone", "+86 102 1398 7000"), ("id_number", "QQ 33 84 22 C"), ("id_number", "90008807-D"), ("email", "a [at] b [dot] example"), ("address", "C/ del Olivar, 803"), ("address", "北山路 12号"), ("name", "QUILL J. NETHER"), ("name", "Anna van der Berg"), ("name", "张伟")])
def test_format_is_kept(kind, value):
    out = surrogates.formatted(kind, value, [surrogates.draw(p, e, b"k") for p, e in surrogates.parts_of(kind, value)], b"k")
    if kind in ("phone", "id_number"):
        assert shape(out) == shape(value) and out != value
    assert out.isupper() == value.isupper() and (" [at] " in out) == (" [at] " in value) and out.startswith("C/") == value.startswith("C/") and ("号" in out) == ("号" in value) and (" van der " in out) == (" van der " in value)
    assert out != value


def test_long_odd_texts_take_linear_time():
    import time

    t = time.time()
    for text in ("Calle " + "A" * 5000, "Plaza " + "Aa" * 5000 + " x", "a." * 20_000 + "@", "1 " * 20_000, "Thanks to " + "Ab " * 20_000, "由" * 20_000, "( " * 20_000, "A" * 50_000, "x@" * 10_000, "王" * 20_000, "0" * 30_000, "12-34 " * 5000, "http://" + "a@b.cc " * 5000):
        pii.mentions(text, TAGGER)
    assert time.time() - t < 20


def corpus(spark):
    """6,000 short texts; names stand in every fifth, each word of a kind in every seventh."""
    given, family = [w.title() for w in names.FEMALE[:40]], [w.title() for w in names.FAMILY[:37]]
    return [(i, f"parcel {'blue' if i % 7 else 'brass'} {i} " + (f"handed to {given[i % 40]} {family[i % 37]} // ok" if i % 5 == 0 else "Load Balancer was restarted") + (" 客户弋秋反馈" if i % 3 == 0 else "")) for i in range(6000)]


def test_tagger_is_fitted_on_every_text(spark):
    docs = corpus(spark)
    surnames, given = frozenset(names.ZH_FAMILY) | {"南", "沐"}, frozenset("芷岚")
    records = [r for _, t in docs for *_, r in [*names.latin_candidates(t), *names.han_candidates(t, surnames, None, given=given)]]
    words = names.Counter(w for _, t in docs for w in names.common_words(t))
    want = names.train(LEX, records, list(words.items()), len(docs))
    got = pii.fit(frame(spark, docs), lexicon(spark)).value
    assert got.vocabulary == want.vocabulary and "brass" in got.vocabulary and got.zh_common == want.zh_common and got.cues == want.cues
    assert got.weights.keys() == want.weights.keys() and all(abs(w - got.weights[f]) < 1e-6 for f, w in want.weights.items())
    assert got.platt == pytest.approx(want.platt, abs=1e-6)


def test_fit_is_the_same_where_its_rows_stay_on_the_executors(spark, monkeypatch):
    from functools import partial

    from tracewake.llm import corpus as records
    from tracewake.llm import sparse

    monkeypatch.setattr(sparse, "logistic", partial(sparse.logistic, rounds=5))
    docs = frame(spark, corpus(spark)[:500])
    here = pii.fit(docs, lexicon(spark)).value
    monkeypatch.setattr(records, "LOCAL_BYTES", 0)
    there = pii.fit(docs, lexicon(spark)).value
    assert here.weights.keys() == there.weights.keys() and all(abs(w - there.weights[f]) < 1e-6 for f, w in here.weights.items())
    assert here.platt == pytest.approx(there.platt, abs=1e-6) and here.cues == there.cues
