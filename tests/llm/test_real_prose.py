"""The bands of the quality rules on texts that people wrote."""

import pydoc_data.topics
import random

import pytest

from lodestone.llm import quality_rules
from lodestone.llm.queries import vocabulary

#: The first article of the Universal Declaration of Human Rights.
ARTICLE = {
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחוה.",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
}


def kept(spark, rows):
    found = quality_rules.measure(spark.createDataFrame(rows, "lang string, text string"), vocabulary("piece_bpe_32k.model")).collect()
    return [(r["lang"], r["rules"]["chars_per_token"], r["rules"]["kept"]) for r in found if not r["rules"]["base_failed"]]


def test_english_is_kept(spark):
    found = kept(spark, [("en", t) for t in pydoc_data.topics.topics.values() if len(t.split()) >= 100])
    assert len(found) >= 40 and all(k for *_, k in found)


def test_other_languages_are_kept(spark):
    found = kept(spark, [*ARTICLE.items(), (None, ARTICLE["ru"]), ("xx", ARTICLE["pl"])])
    assert len(found) >= 11 and [x for x in found if not x[2]] == []


@pytest.mark.parametrize("lang,letters", [("en", "abcdefghijklmnopqrstuvwxyz"), ("fr", "abcdefghijklmnopqrstuvwxyz"), ("it", "abcdefghijklmnopqrstuvwxyz"), ("ru", "абвгдежзийклмнопрстуфхцчшщыьэюя")])
def test_fragments_are_rejected(spark, lang, letters):
    rng = random.Random(2)
    rows = [(lang, " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(300))), (lang, " ".join(rng.choices(letters, k=400)))]
    found = kept(spark, rows)
    assert len(found) == 2 and not any(k for *_, k in found)


def test_script():
    assert [quality_rules.script(ARTICLE[k].encode()) for k in ("de", "ru", "el", "he", "ko", "hi")] == ["Latn", "Cyrl", "Grek", "Hebr", "Hang", "Deva"]
    assert [quality_rules.script(x.encode()) for x in ("", "12 !", "人人生而自由", "すべての人間は自由")] == ["*", "*", "Hani", "Kana"]
