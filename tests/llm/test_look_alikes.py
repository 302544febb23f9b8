import random
import unicodedata

from folioscope.llm import visual_form as vf


def test_fillers_numerals_cherokee_and_armenian():
    same = [
        ("aㅤb", "ab"), ("aᅟb", "ab"), ("aᅠb", "ab"), ("aﾠb", "ab"), ("a⁥b", "ab"), ("ⅠⅡ Ⅿ ⅷ", "III M viii"),
        ("ᎠᎪᎢᎪ", "DATA"), ("սոյ", "unj"), ("ՕՍՏ", "OUS"),
    ]
    for odd, plain in same:
        assert vf.visual_forms([odd, plain]) == [plain, plain], odd
    assert len(set(vf.visual_forms(["Ⅰ", "1", "i", "l"]))) == 4


def test_letters_of_one_script_stay_apart():
    for low, high in ((0x13A0, 0x13F6), (0x531, 0x557), (0x561, 0x588)):
        letters = [chr(c) for c in range(low, high)]
        assert len(set(vf.visual_forms(letters))) == len(letters)


def test_font_forms_minus_and_wider_look_alikes():
    same = [("𝐇𝐞𝐥𝐥𝐨 𝟏𝟐", "Hello 12"), ("ℂℍ", "CH"), ("ѵᴏᴡ", "vow"), ("ꓮꓐꓚ", "ABC"), ("ⲥⲟⲣ", "cop"), ("a−b", "a-b"), ("－", "-"), ("𝖆́", "á")]
    for odd, plain in same:
        assert vf.visual_forms([odd, plain]) == [plain, plain], odd
    assert len(set(vf.visual_forms(["x²", "x2", "①", "1", "a–b", "a-b", "a，b", "a,b"]))) == 8


def test_composition_is_that_of_the_unicode_database():
    r = random.Random(8)
    late = [0x9C7, 0x9BE, 0x9D7, 0xCC6, 0xCC2, 0xCD5, 0xDD9, 0xDCF, 0xDCA, 0x1025, 0x102E, 0x1100, 0x1112, 0x1161, 0x1175, 0x11A8, 0x11C2, 0xAC00, 0xAC01, 0x301, 0x65, 0x323, 0x93C, 0x928, 0x1B05, 0x1B35]
    texts = ["".join(chr(r.choice(late)) for _ in range(r.randint(1, 8))) for _ in range(5000)]
    assert vf.visual_forms(texts) == [unicodedata.normalize("NFC", x) for x in texts]


def test_a_form_does_not_depend_on_its_neighbours(spark):
    texts = ["ẹ́", "각", "ᆨx", "ক", "া", "ে", "plain", None, "со"]
    assert vf.visual_forms(texts) == [vf.visual_forms([x])[0] for x in texts]
    assert vf.visual_forms(texts[::-1]) == vf.visual_forms(texts)[::-1]


def test_classes(spark):
    rows = [(1, "copy"), (2, "сору"), (3, "copy"), (3, "copy"), (4, None), (5, " "), (6, "alone"), (None, "copy")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in vf.look_alike_classes(df, "doc_id", "text").collect())
    assert got == [(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2), (6, 6, 1, 1)]
    assert vf.look_alike_classes(df.limit(0), "doc_id", "text").count() == 0
