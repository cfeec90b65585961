import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm.sentences import sentence_units, sentences

# Sentences of each text are parted by "|"; the blank or line break after one isn't part of it.
CASES = [
    "The call came at 7.30 a.m. from the U.S. office. |We start at 10.15 p.m. |slowdial.example is down again. |34 callers left.",
    "Dr. Skurin and Prof. Oval met in Ostheim. |Mr. and Mrs. Wexor of Mt. Tarl sent it. |G. T. Lumurin signed it.",
    "“It broke. Nobody noticed,” said Benelo later. |\"Is this on?\" asked Mavikka from the back. |‘Where?’ asked Bebette; nobody knew. |“We keep it.” |Really?!",
    "It ended. |(This is vol. 8. Nobody owns vol. 1.) |The St. Hall (approx. 47 seats) was full.",
    "We packed cables, tapes, etc. |(This is it.) |Nobody moved... |98 callers left. |We waited … and then waited again. |It ran long...or so it felt.",
    "No. 9 was the loudest take. |No. |It is called take_58.wav, not mix.mp3. |Cf. Pell et al., ch. 9, for details. |See ep. 84, fig. 9, for more.",
    "I have no idea.|No. 2 was the loudest take.|Exactly! |A failed upload. 🎧 |Next one. :)|\nTitle\n|- 0:00 a leaking roof\n|- 5:09 the choir",
    "Am 9. Mai kam Dr. Skurin. |Es war Folge 8. |47 Anrufe gingen ein. |Das gilt z. B. für E. G. Tor. |Rund 9,9 Mio. Abrufe inkl. Wiederholungen kamen. |Siehe Abb. 2 auf S. 45. |Es geht um d. h. nichts.",
    "„Läuft das schon?“, fragte Belinde. |»Wozu? Warum jetzt?«, rief Ivxavi. |„Wir behalten ihn.“ |Schreibt uns wegen Aufnahmen usw. |77 Anrufe.",
    "EE. UU. no emitió el episodio. |A las 9.9 p. m. llegó Ud. con la lista. |—¿Está encendido? —preguntó Nelo. |¿De verdad?! |Cuesta 9.9,9 euros aprox. este mes. |«Se acabó. De verdad», dijo Nelo.",
    "« C'est fini. Vraiment », dit Nelo. |« Ça tourne ? » demande Nelo. |« On garde tout. » |Cf. p. 31 du vol. 9 pour la suite. |Le prix est de 9 euros env. |M. Oval et Mme Eska sont venus. |Et puis... rien !",
    "См. стр. 76, рис. 3. |«Где? Когда?» — спросил гость. |Мы взяли кабели и т. д. |В 2071 г. студия переехала в др. город. |Проф. Д. Вескин приехал в 9 ч. утра. |Мы ждали… и снова ждали.",
    "Γιατί είναι ακόμα εδώ; |Πήραμε καλώδια κ.λπ. |Ο κ. Βεσκάλος μίλησε. |Κανείς δεν μίλησε· όλοι άκουγαν. |Κόψαμε π.χ. το 9,9.",
    "“कहाँ? कब?” मेहमान ने पूछा। |प्रो. तोरमेन 9 बजे आए। |हम रुके… और फिर रुके। |“सब ख़त्म। सच में।” उसने कहा।",
    "«أين؟ متى؟» سأل الضيف. |وصل أ. د. تورمان في الساعة 15. |لم يتكلم أحد. |انتظرنا… ثم انتظرنا مرة أخرى.",
    "“不行！太晚了！”他喊道。|主持人说：“结束了。真的。”|昨天很意外。|《你好！耳机》这期又回来了。|我们等啊等……还是没有结果。|第9期（见第9页。）讲的是电缆。",
    "「無理！遅い！」と叫んだ。|待って……また待った。|『もしもし？』の回が戻ってきた。|聞こえますか？|第6回（p.38参照。）はパンの回の話です。",
    "Kalinde: เสียงดังขึ้น 9.9 เดซิเบล |รายการเริ่มเวลา 9.9 น. |ผู้ดำเนินรายการหัวเราะเบาๆ",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    want = [p.strip() for p in case.split("|")]
    text = case.replace("|", "")
    assert [text[a:b] for a, b in sentences(text)] == want


def test_empty_and_marks():
    assert len(sentences("He agreed. Note: it was late.")) == 2
    assert len(sentences("G. T. Lumurin: It was late.")) == 1
    assert len(sentences("12. Mai war es.")) == 1
    assert sentences(None) == sentences("") == sentences(" \t\r\n ") == []
    assert sentences(" a\r\n\r\nb ") == [(1, 2), (6, 7)]
    assert sentences(" x y") == [(1, 2), (3, 4)]
    assert [b - a for a, b in sentences("[00:10] Nelo: 1.5 is it. Yes.")] == [24, 4]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" .!?…“”\"'()«»「」\nAaż1ก।。é:;,-—"), st.characters()), max_size=120))
def test_cover_and_order(text):
    found = sentences(text)
    covered = 0
    for a, b in found:
        assert covered <= a < b <= len(text) and text[a:b] == text[a:b].strip() and not any(c in text[a:b] for c in "\n\r  \x85")
        assert not text[covered:a].strip()
        covered = b
    assert not text[covered:].strip()


def test_linear_in_length():
    for text in ("a. b " * 40_000, "(" * 100_000, "“" * 50_000 + "x. Y", "." * 100_000, "x" * 300_000, '" ' * 60_000, "«a. »" * 20_000, "; " * 60_000, "a; " * 40_000, "x.Y" * 40_000, "(" * 40_000 + "a. B" * 9, "A. " * 40_000, "ca. " * 40_000, ". # " * 40_000):
        assert sentences(text)[-1][1] <= len(text)


def test_operator(spark):
    df = spark.createDataFrame([(1, "So it is. Yes.", 5), (2, None, 5), (3, " ", 5), (1, "So it is. Yes.", 5)], "doc_id bigint, text string, start_char int")
    assert sorted(map(tuple, sentence_units(df).collect())) == [(1, 0, 9), (1, 0, 9), (1, 10, 14), (1, 10, 14)]
    assert sentence_units(df.limit(0)).count() == 0
    told = spark.createDataFrame([(1, "Me. Dupont", "fr"), (2, "Me. Dupont", "en"), (3, "Me. Dupont", None)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in sentence_units(told, language="lang").collect()) == [1, 2, 2, 3]


def test_all_terminators_of_the_property():
    import regex

    from earshot.llm.sentences import _points, _terminators

    every = {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and regex.match(r"\p{STerm}", chr(c))}
    assert every - set().union(*_points()) == {".", "\u2024"}
    assert all(_terminators()[1].match(c) for c in every)


@pytest.mark.parametrize("text", ["He gave it to me. Then he left.", "She wore a cap. It was red.", "I ate a fig. It was sweet.", "He is my ex. She left.", "We had a sect. It grew.", "ខ្ញុំទៅផ្សារ។ គាត់មក។", "Sie war am Bord. Alles ging gut.", "On est avec toi. Rien ne va."])
def test_words_that_are_abbreviations_elsewhere(text):
    assert len(sentences(text)) == 2


@pytest.mark.parametrize(
    ("text", "language", "n"),
    [
        ("Me. Dupont est là.", "fr", 1), ("Me. Dupont left.", "en", 2), ("Véase cap. 3 ahora.", "es-MX", 1), ("Siehe Bd. 3 dort.", "German", 1), ("a vol. II b. C", None, 1), ("See fig. 4 there.", None, 1),
        ("Am 9. Mai kam er.", "de", 1), ("I had 9. May came.", "en", 2), ("See ch. XIV today.", "EN", 1), ("No. I know.", "en", 2), ("См. стр. 5 там.", "en", 1), ("Word " + "x" * 100_000 + ". Next " + "One. " * 3, "en", 4),
    ],
)
def test_abbreviations_by_language(text, language, n):
    assert len(sentences(text, language)) == n


def test_no_length_matters():
    pad = " " * 5000
    for text in ("It was" + pad + "e.g." + pad + "so here.", "He said “" + "really " * 3000 + "no.”" + pad + "and left.", "Wait... " + "# " * 3000 + "and on.", "at " + "A." * 3000 + " there."):
        assert len(sentences(text)) == 1
    assert len(sentences("Done. " + "# " * 3000 + "Next.")) == 2


def test_signs():
    assert sentences("abc\n---\ndef") == [(0, 3), (4, 7), (8, 11)]
    assert sentences("It is so. -- # Next.") == [(0, 14), (15, 20)]
    assert len(sentences("“Now?” Ⅻ asked he.")) == 1


@pytest.mark.parametrize("mark", ["\u17d4", "\U00010a56", "\U00011047", "\U00011141", "\ufe16"])
def test_terminators_of_rare_scripts(mark):
    assert len(sentences(f"aaa{mark} bbb{mark}")) == 2
