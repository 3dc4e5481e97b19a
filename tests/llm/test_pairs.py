import random

import pytest

from riftlens.llm import pairs as P

QUESTIONS = {
    "en": ["Why does `f` return early when the {} is empty?", "Who else calls `g` after this change to the {}?", "Should the {} be locked before this runs?"],
    "de": ["Warum kehrt `f` so früh zurück, wenn {} leer ist?", "Muss {} vor dem Aufruf gesperrt werden?"],
    "fr": ["Pourquoi `f` sort-elle aussi tôt quand le champ {} est vide ?", "Que devient la valeur {} si la ligne échoue ?"],
    "es": ["¿Por qué `f` termina tan pronto cuando {} está vacío?", "¿Qué pasa con el valor {} si falla la línea?"],
    "ko": ["{} 값이 비어 있으면 `f` 함수는 왜 바로 반환하나요?"],
}
ANSWERS = {
    "en": ["The other caller passes a copy of the {}, so nothing is shared. It lives in a/b.go.", "I cannot find a second writer for the {}, so one lock is enough. The guard keeps it from being counted twice.", "Sorry for the confusion above: it runs once per {}, not once per call. It is not possible to reach that line."],
    "de": ["Die Abfrage davor verhindert, dass {} doppelt gezählt wird. Es gibt noch einen Aufrufer."],
    "fr": ["La condition évite de compter deux fois {}. Les tests se trouvent dans le même dossier."],
    "es": ["La condición evita que se cuente dos veces {}. Las pruebas están en la misma carpeta."],
    "ko": ["조건 덕분에 {} 값이 두 번 세어지지 않습니다. 관련 테스트는 같은 폴더에 있습니다."],
}
WORDS = ["crate", "ledger", "quota", "vessel", "badge", "depot", "shelf"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(list(QUESTIONS))
        out.append((rng.choice(QUESTIONS[lang]).format(rng.choice(WORDS)), rng.choice(ANSWERS[lang]).format(rng.choice(WORDS))))
    return out


@pytest.fixture(scope="module")
def model():
    return P.train(corpus(400, 1))


def judge(model, q, a):
    w, t = model
    margin = P.scores(w, *P.features(q, a)) - t
    k = int(margin.argmax())
    return P.DEFECTS[k] if margin[k] > 0 else None


def test_held_out_accuracy(model):
    rows = P.synthesize(corpus(300, 2), seed=99)
    right = sum(judge(model, q, a) == (P.DEFECTS[k] if k >= 0 else None) for q, a, k in rows)
    whole = [(q, a) for q, a, k in rows if k < 0]
    assert right / len(rows) >= 0.96
    assert sum(judge(model, q, a) is not None for q, a in whole) <= 0.01 * len(whole)


@pytest.mark.parametrize(
    "q, a, want",
    [
        ("Who calls `f`?", None, "empty_answer"), ("Who calls `f`?", " \n", "empty_answer"), ("Who calls `f`?", "N/A", "empty_answer"), ("Who calls `f`?", "> ", "empty_answer"),
        ("Who else calls `f` here?", "> Who else calls `f` here?\n", "copied_question"), ("Who else calls `f` here?", "who else calls f here", "copied_question"),
        ("Who else calls `f` here?", "> Who else calls `f` here?\n\nThe other caller is in a/b.go and passes a copy.", None), ("Who else calls `f` here?", "Only `g`.", None), ("Is that so?", "Yes.", None),
        ("Who else calls `f` here?", "Sorry, I cannot help with this request.", "refusal"), ("Who else calls `f` here?", "I cannot find a second caller, so the lock is enough.", None),
        ("Who else calls `f` here?", "Die Abfrage davor verhindert, dass der Wert doppelt gezählt wird.", "other_language"), ("Who else calls `f` here? Please answer in German.", "Die Abfrage davor verhindert, dass der Wert doppelt gezählt wird.", None),
        ("Who else calls `f` here?", "The guard on that line keeps the ledger from being cou", "truncated_answer"), ("Who else calls `f` here?", "The guard keeps it safe.\n```go\nif x {", "truncated_answer"), ("Who else calls `f` here?", "The guard on that line keeps …", "truncated_answer"),
        ("Who else calls `f` here?", "The guard keeps it safe.\n```go\nif x {}\n```", None), ("Who else calls `f` here?", "See these:\n- `a/b.go:12`\n- `c/d.rs:4`", None),
    ],
)
def test_cases(model, q, a, want):
    assert judge(model, q, a) == want


def test_training_is_fixed_by_its_pairs():
    a, b = P.train(corpus(60, 3)), P.train(corpus(60, 3)[::-1])
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


SCHEMA = "thread_id string, msg_seq int, author string, text string, kind string, received_at int, question string"


def test_pairs_of_turns(spark):
    rows = [
        ("t", 0, "you", "Who calls `f`?", "question", 1, "clash"), ("t", 1, "AI ", "old", None, 1, ""), ("t", 1, "AI ", "new", "answer", 2, ""), ("t", 1, "AI ", "new", "answer", 2, ""), ("t", 2, "you", "do it", "command", 1, ""), ("t", 3, "ai", "done", None, 1, ""),
        ("u", 0, "you", "Open?", "question", 1, ""), ("v", 0, "you", "One?", "question", 1, ""), ("v", 1, "you", "Two?", "question", 1, ""), ("v", 2, "Assistant", None, None, 1, ""), (None, 0, "you", "q", "question", 1, ""), ("w", None, "you", "q", "question", 1, ""), ("x", 0, None, None, "question", 1, ""), ("x", 1, "ai", "y", None, 1, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.thread_id, r.question_seq, r.question, r.answer) for r in P.pairs_of(df).collect())
    assert got == [("t", 0, "Who calls `f`?", "new"), ("v", 1, "Two?", None), ("x", 0, None, "y")]
    assert P.defects(df.limit(0)).count() == 0
    judged = {(r.thread_id, r.question_seq): r.defect for r in P.defects(df).collect()}
    assert judged[("v", 1)] == "empty_answer" and len(judged) == 3
