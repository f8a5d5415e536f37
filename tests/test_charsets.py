"""Texts in several encodings come back as they were."""

import pytest
from pyspark.sql import functions as F

from textloom.sources.charsets import decoded, detected

TEXTS = {
    "fr": "L'été dernier, le garçon a mangé à la fenêtre où l'œuvre naïve était posée. « Ça va très bien », dit-elle.",
    "de": "Die Straße führt über schöne Hügel; für Größe und Übermut gibt es Äpfel und Öl.",
    "ru": "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. Выберите таблицу.",
    "el": "Η γρήγορη αλεπού πηδάει πάνω από τον τεμπέλη σκύλο. Καλημέρα κόσμε.",
    "ja": "テーブルを作成するには、次の文を使います。データベースの行はすべて残ります。",
    "zh": "数据库中的每一行都会保留。请先创建一个新的表，然后再插入数据，最后检查结果是否正确。",
    "en": "Plain words only, nothing else.",
}
CASES = [("fr", "utf-8"), ("fr", "utf-8-sig"), ("ru", "utf-16"), ("fr", "utf-16-le"), ("en", "utf-16-be"), ("fr", "cp1252"), ("de", "cp1252"), ("ru", "cp1251"), ("ru", "koi8-r"), ("el", "iso8859-7"), ("ja", "shift_jis"), ("ja", "euc-jp"), ("zh", "gb18030"), ("en", "ascii")]


@pytest.mark.parametrize("lang,name", CASES)
def test_texts_come_back(lang, name):
    text = " ".join([TEXTS["en"], TEXTS[lang], TEXTS[lang].lower()])
    assert detected(text.encode(name))[::2] == (text, 0)
    long = text + " x" * 60_000 + TEXTS[lang]
    assert detected(long.encode(name))[0] == long


def test_what_is_no_text_is_replaced(spark):
    assert detected(b"") == ("", "utf-8", 0)
    assert detected(b"\xff\xff\x81\x8d\x8f")[1:] == ("utf-8", 5)
    rows = spark.createDataFrame([(1, "é".encode("cp1252") + b" t" + "été".encode("cp1252")), (2, None), (3, "é".encode())], "id long, content binary")
    got = {r["id"]: (r["d"]["text"], r["d"]["encoding"], r["d"]["replaced"]) for r in rows.select("id", decoded(F.col("content")).alias("d")).collect()}
    assert got[1] == ("é tété", "cp1252", 0) and got[2] == (None, None, None) and got[3] == ("é", "utf-8", 0)
