import random

import pytest
from hypothesis import given, settings, strategies as st

from kmerloom.llm.mail import paragraphs
from kmerloom.llm.sentences import UNBALANCED, _length, best_chain, ends, message_sentences, quote_pairs, repaired, sentences

# "|" marks the expected ends
CASES = [
    'Dr. Velmor saw Fig. 3 at 6 p.m. on Friday.| The visitors left at 7 p.m.| See http://a.example/q?id=5.| "Who," she asked, "has it?"| I do.',
    "Odra wrote \"It failed again. Try the other node.\" and went home.| iSketch is back.| mRNA is not, e.g. ZQA_1.| He said: 'Wait for me!' and closed ticket No. 2.| Really?!| Well… that was all.",
    "(The old index is on node1.example.)| I asked Zofi (she runs it; see her note from 10.30.) and got no reply.| The U.L.F. committee and R. F. Ost met, etc.| Next.",
    "Die Probe lief am 27. März bzw. am 18. April durch.| Siehe z. B. Abb. 3 von Dr. Ost.| Ravi meinte: „Es ging schief. Bitte noch einmal.“ und legte auf.| Was nun?| Kabel usw.| Na ja…",
    "« Qui a vidé le dossier ? » demanda Brel.| Le Dr Ost arrive à 9 h.| Noor a dit : « Tout est perdu. On recommence. » et il est parti.| Quel désordre !| Fin.",
    "¿Alguien sabe?| El Sr. Ost vive en la Avda. Maren núm. 9.| «¿Está ordenado?», preguntó Ana.| ¡Qué desastre!| Fin.",
    "Нужны кабели и т. д.| А. В. Весник спросил: «Где данные? Почему пусто?» и ушёл.| См. рис. 3.| «Всё пропало!» — сказал Лозин.| Это было в 2019 г. на узле.",
    "Πότε θα έρθει ο νέος πίνακας;| «Ποιος έσβησε τον φάκελο;» ρώτησε η Asta.| Ο κ. Ost ξεκίνησε.| Δείτε π.χ. τη σελ. 9.",
    "本当ですか？！|「索引は整列済みですか？」とRaviさんが尋ねました。|（古い行列はまだnode1.exampleにあります。）|値は0.8でした。",
    "旧的矩阵还在（请不要删除。），谢谢。|Ilmar说：“全都没了。重新来吧！”然后就走了。|我们等了很久……队列没有动。|好。",
    'डॉ. Ost ने काम शुरू किया।| Hedda ने कहा, "सब मिट गया। फिर से करो।" और फ़ोन रख दिया।| जल्दी करो!| मान 0.5 निकला।',
    "أعاد د. Ost التشغيل أمس.| قال Brel: «ضاع كل شيء. لنبدأ من جديد.» ثم خرج.| هل القائمة جاهزة؟| نعم.",
    "نمونہ مل گیا۔| کیا فہرست تیار ہے؟| جلدی کریں!| ٹھیک ہے۔",
    "በመጨረሻ ተጠናቀቀ!| ዋጋው 1.5 ነው።| መቼ ይደርሳል?| እሺ።",
    "เราเก็บคีย์ไว้ 9 เปอร์เซ็นต์ของทั้งหมด| ไฟล์ lane-4.fastq ว่างเปล่าตั้งแต่เมื่อวาน| กรุณาส่งตารางให้ด้วย",
    "1. The list number is no sentence.| Two follow.",
]


@pytest.mark.parametrize("marked", CASES)
def test_languages(marked):
    text = marked.replace("|", "")
    want, at = [], 0
    for part in marked.split("|")[:-1]:
        at += len(part)
        want.append(at - 1)
    assert ends(text) == want


def chain_score(chain, stops, closing, opening, pairs):
    """The plain sum over the spans."""
    at, score = 0, 0.0
    for j in [*chain, len(stops) - 1]:
        inside = lambda x: stops[at] < x <= stops[j]  # noqa: B023, E731
        score += opening[at] + closing[j] + _length(stops[j] - stops[at]) - UNBALANCED * sum(inside(a) != inside(b) for a, b in pairs)
        at = j
    return score


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6))
def test_the_chain_is_the_best_of_all(seed):
    rnd = random.Random(seed)
    steps = [rnd.choice([1, 2, 3, 40, 200, 260, 700]) for _ in range(rnd.randrange(1, 9))]
    stops = [-1]
    for x in steps:
        stops.append(stops[-1] + x)
    marks = sorted(rnd.sample(range(-1, stops[-1] + 1), min(stops[-1] + 1, 2 * rnd.randrange(5))))
    pairs, stack = [], []
    for left, x in zip(range(len(marks), 0, -1), marks, strict=True):  # any nesting
        if stack and (len(stack) >= left or rnd.random() < 0.5):
            pairs.append((stack.pop(), x))
        else:
            stack.append(x)
    pairs = sorted(p for p in pairs if not {*p} & {*stops})
    closing = [0.0, *(rnd.uniform(-8, 9) for _ in stops[2:]), 0.0]
    opening = [0.0, *(rnd.uniform(-8, 9) for _ in stops[2:]), 0.0]
    inner = range(1, len(stops) - 1)
    best = max(chain_score([j for j in inner if mask >> j & 1], stops, closing, opening, pairs) for mask in range(0, 2 ** (len(stops) - 1), 2))
    got = best_chain(stops, closing, opening, pairs)
    assert abs(chain_score(got, stops, closing, opening, pairs) - best) < 1e-6


def test_spans_decide_otherwise_than_boundaries():
    """Two stray marks enclose many sentences: every boundary between them cuts a pair, so a rule for single boundaries, which
    holds a short quotation together, keeps all of it as one sentence. Only the two spans with a mark in them are unbalanced."""
    sentence = "The index builder has used more memory than last year"
    text = f'The file "x failed. {". ".join([sentence] * 12)}. Nobody wants the 3.5" one. It went home.'
    assert any(b - a > 600 for a, b in quote_pairs(text))
    assert len(ends(text)) == 14 and len(ends(f'Ravi wrote "{sentence}. {sentence}." and left. Then he slept.')) == 1


def test_long_paragraphs_have_no_window():
    doubtful = "see Fig. 3 and Dr. Ost, " * 400  # 800 possible ends in one sentence
    text = f"One is here. We {doubtful}that is all. Two is here."
    assert ends(text) == [11, len(text) - 14]


def test_parts_may_be_nested_to_any_depth():
    text, close = "Subject: x\n", ""
    for k in range(60):
        text += f"Content-Type: multipart/mixed; boundary=b{k}\n\n--b{k}\n"
        close = f"\n--b{k}--\n" + close
    text += "\nOne. Two." + close
    close = ""
    assert [text[a : b + 1] for _, a, b in message_sentences(text)] == ["One.", "Two."]


MAIL = "From a Mon\r\nSubject: x\r\nContent-Type: multipart/mixed;\r\n boundary=\"b\"\r\n\r\npreamble. No.\r\n--b\r\n\r\nOne. Two\r\nlines. Three.\r\n> Quoted. Text.\r\nFour. Five.\r\n-- \r\nSig. No.\r\n--b\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA. BBBB.\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>No. No.</p>\r\n--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\nNo. No.\r\n--b--\r\nEpilogue. No.\r\n"


def test_only_what_is_in_clear_counts():
    texts = [MAIL[a:b] for a, b in paragraphs(MAIL)]
    assert texts == ["One. Two\r\nlines. Three.", "Four. Five."]
    assert [MAIL[a : b + 1] for _, a, b in message_sentences(MAIL)] == ["One.", "Two\r\nlines.", "Three.", "Four.", "Five."]


def test_plain_and_broken_messages():
    assert [b for _, _, b in message_sentences("A: b\n\nOne. Two.")] == [9, 14]
    assert message_sentences(None) == [] and message_sentences("") == [] and message_sentences("no body at all") == []
    assert message_sentences("Content-Type: multipart/mixed\n\nOne. Two.") == []
    assert len(message_sentences("\nNo headers. Here.")) == 2


def test_damaged_text_keeps_its_places():
    good = "A: b\n\nÉcrivez à Fr. Dr. Ost… « Où ? » demanda Ana. Fin."
    bad = good.encode().decode("latin-1")
    text, places = repaired(bad)
    assert text == good and len(places) == len(good)
    found = [bad[a : b + 1] for _, a, b in message_sentences(bad)]
    assert [x.encode("latin-1").decode() for x in found] == [good[a : b + 1] for _, a, b in message_sentences(good)]


def test_operator(spark):
    body = "A: b\n\n" + "This is it. " * 20_000
    df = spark.createDataFrame([(1, "A: b\n\nOne. Two.", 5), (1, "A: b\n\nOne. Two.", 5), (2, None, 5), (3, "", 5), (4, body, 5)], "doc_id long, text string, end_char int")
    got = sentences(df, "doc_id", "text", with_text=True).collect()
    assert sorted(r.sentence for r in got if r.doc_id == 1) == ["One.", "One.", "Two.", "Two."]
    assert sum(r.doc_id == 4 for r in got) == 20_000 and {r.doc_id for r in got} == {1, 4}
    assert sentences(df.limit(0), "doc_id", "text").count() == 0
