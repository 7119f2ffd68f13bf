"""Quality of clean texts in scripts beyond Latin, with and without spaces between words."""
import random
from collections import Counter

import pytest

from textguard.llm import weak_quality

PARTS = {
    "zh": ("", "。", ["人工智能", "正在改变", "我们的", "生活方式", "许多城市", "已经开始", "使用新的", "技术", "来改善", "交通", "医疗服务", "研究人员", "认为", "这些变化", "未来十年", "继续发展", "学校", "老师", "介绍了", "历史"]),
    "ja": ("", "。", ["東京の", "春は", "とても", "美しく", "多くの人々が", "公園で", "桜を", "見ながら", "友達や", "家族と", "楽しい", "時間を", "過ごします", "天気が", "よければ", "夜まで", "続くことも", "あります", "カメラを", "持って"]),
    "th": ("", " ", ["กรุงเทพ", "เป็น", "เมืองหลวง", "ของ", "ประเทศไทย", "และมี", "ประชากร", "อาศัยอยู่", "จำนวนมาก", "อาหารไทย", "มีชื่อเสียง", "ไปทั่วโลก", "นักเรียน", "เดินทาง", "ทุกวัน", "ตลาดน้ำ", "สวยงาม", "แม่น้ำ", "ฤดูฝน", "เริ่มต้น"]),
    "hi": (" ", "। ", ["भारत", "एक", "विशाल", "देश", "है", "जहाँ", "अनेक", "भाषाएँ", "बोली", "जाती", "हैं", "विभिन्न", "संस्कृतियाँ", "साथ", "रहती", "लोग", "त्योहार", "उत्साह", "मनाते", "विश्वविद्यालय"]),
    "ru": (" ", ". ", ["исследователи", "университета", "опубликовали", "результаты", "многолетнего", "наблюдения", "за", "поведением", "перелётных", "птиц", "обитающих", "северных", "областях", "правительство", "сообщило", "международном", "сотрудничестве", "промышленность", "развивается", "быстрее"]),
}


def clean(language, seed):
    space, end, parts = PARTS[language]
    r = random.Random(f"{language}{seed}")
    return "".join(space.join(r.choice(parts) for _ in range(r.randint(8, 14))) + end for _ in range(r.randint(4, 30))).strip()


@pytest.mark.parametrize("language", PARTS)
def test_measures_by_words_have_no_bad_vote_on_clean_languages(language):
    for seed in range(40):
        text = clean(language, seed)
        assert weak_quality.BAD not in weak_quality.votes(weak_quality.measures(text.encode())), text


def test_words_are_measured_in_code_points():
    found = dict(zip(weak_quality.MEASURES, weak_quality.measures(("äöü äöüß " * 20).encode())))
    assert found["word length"] == 3.5 and found["short words"] == 0.5


@pytest.mark.parametrize("each", [4, 30])
def test_clean_languages_are_kept_and_junk_is_not(spark, each):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gold = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [(10**9 + k * 1000 + s, clean(language, s)) for k, language in enumerate(PARTS) for s in range(each)]
    got = {r["doc_id"]: r["keep"] for r in weak_quality.classify(docs.union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [text for doc, text in rows if not got[doc]] == []
    labelled = gold.collect()
    assert sum(got[r["doc_id"]] == (r["quality"] == 1) for r in labelled if r["doc_id"] in got) > 0.97 * len(labelled)


def test_a_labeller_that_fires_widely_and_alone_is_doubted():
    code = lambda bad: sum((2 if k in bad else 1) * 3**k for k in range(10))
    counts = Counter({code(()): 5000, code((6,)): 5000, **{code((k,)): 200 for k in range(4)}})
    found = weak_quality.label_model(counts)
    assert found[code(())] < 0.1 and found[code((6,))] < 0.5 and all(found[code((k,))] > 0.5 for k in range(4))
