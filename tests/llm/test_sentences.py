"""Sentence units on hand-made cases of every language, and edge cases."""

import time

import pytest

from weir.llm.sentences import sentence_ends, sentence_units


def units(text):
    out, start = [], 0
    for end in sentence_ends(text):
        out.append(text[start:end].strip())
        start = end
    assert not text[start:].strip()
    return out


CASES = {
    "en": ["TITLE\n\n", "It may comprise pins, springs, etc. ", "At 1 a.m. the tray (cf. Fig. 2) opened. ", 'It reads "Do not open. Hot." and shuts. ', 'This is a "hinge." ', "pH is kept, e.g. low. ", "The gap is 7.5 in. wide, cf. Fig. 28. ", "18 screws hold v4.16.2. ", "It turns ... slowly! ", "Is it?\n\n", "[0001] Other parts.\n\n", "1. A tray.\n", "2. The tray of claim\n1, wherein it is insu-\nlated.The"],
    "de": ["Am 7. Tag wurde sie bei 34,71 °C geprüft. ", "Auf ihr steht „Nicht öffnen. Heiß!“ gut lesbar. ", "Sie hat Stifte usw. ", "Vgl. dazu Abs. 12 auf S. 3, z. B. bei 18.000 Umdrehungen gem. Nr. 2. ", "So heißt die „Platte.“ ", "Ist sie dicht?"],
    "fr": ["Un jeu d'env. 2,5 mm subsiste (cf. tabl. 8). ", "Elle porte « Ne pas ouvrir. Chaud ! » bien lisible. ", "La vis, c.-à-d. la tige, tient, p. ex. ici. ", "On parle de « broche ». ", "Est-elle fixe ? ", "Oui, etc. ", "La fin"],
    "es": ["Se usan tornillos, etc. ", "¿Está bien? ", "¡La n.º 9 no! ", "Dice «No abrir. Caliente.» siempre. ", "Véase la pág. 17, etc., y p. ej. la fig. 2."],
    "ja": ["蓋部には「開けるな。高温である。」と表示される。", "温度が３３．１２℃のとき動く(例.弁体)!", "第2.1節である．", "動くか?\n", "【請求項1】装置。", "【請求項2】装置。"],
    "zh": ["上标有“请勿打开。高温。”字样。", "温度可达６６．７℃!", "第7.18节．", "1.一种装置。\n", "2.根据权利要求1所述的装置。"],
    "th": ["ห้องเย็น ", "เมื่อเป็น 114.68 องศาเปิด ", "ปิดแล้ว\n\n", "1. อุปกรณ์ "],
    "hi": ['उस पर "न खोलें। गर्म है।" लिखा है। ', "लगभग 59.4 मि.मी. की दूरी है| ", "सं. 26 है । ", "क्या यह है? ", "2. दावा।"],
}


@pytest.mark.parametrize("lang", CASES)
def test_hand_made(lang):
    parts = CASES[lang]
    want = []
    for p in parts:
        if lang == "en" and p.endswith("lated.The"):
            want += [p[:-3].strip(), "The"]
        else:
            want.append(p.strip())
    assert units("".join(parts)) == want


def test_edges():
    assert sentence_ends("") == [] and sentence_ends(" \n\n ") == []
    assert units("no mark at all") == ["no mark at all"]
    assert units("...") == ["..."] and units("?!") == ["?!"]
    assert units("a\n\n\n\nb") == ["a", "b"]
    assert units("Open (bracket. It ends. So") == ["Open (bracket.", "It ends.", "So"]


@pytest.mark.parametrize("piece", ["The cam turns. ", "1. ", "( ", '" ', "e.g. x ", "。", "ก ก", "a", "„ ", "x? y ", "\n\n", "I. ", "[ ", "Mr. A. "])
def test_long_texts_take_linear_time(piece):
    text = piece * (600_000 // len(piece))
    began = time.process_time()
    ends = sentence_ends(text)
    assert ends == sorted(set(ends)) and time.process_time() - began < 20


def test_operator(spark):
    df = spark.createDataFrame([(1, "A cam. A rod."), (2, None), (3, ""), (1, "A cam. A rod.")], "doc_id bigint, text string").selectExpr("*", "1 AS _id", "2 AS end_pos")
    found = sorted(tuple(r) for r in sentence_units(df, "doc_id", "text").collect())
    assert found == [(1, 0, 6), (1, 0, 6), (1, 1, 13), (1, 1, 13)]
    assert sentence_units(df.limit(0), "doc_id", "text").count() == 0
