"""Broken question and answer pairs.

A multi-label linear classifier (one logistic output per defect over shared features) is trained on synthetic defects:
answers of the corpus are cut, replaced by their question, by refusals, by an answer in another language or by nothing.
Features are hashed word n-grams of the masked answer and pair features: what is left of the answer beyond its question,
how it ends, what language each side has and which one was asked for.  Training takes at most ``TRAIN_PAIRS`` pairs (a
documented bound), those with the smallest key hash; answers that a first fit holds for defective are left out of the
second.  Thresholds are set per defect on held-out pairs.  All pairs are scored.

Defined results
* a pair is a turn of kind question and the assistant's turn at the next msg_seq of its thread; a turn that is stored
  several times counts once, as received last; other turns, nulls in keys and questions without answer give no rows;
* null, empty and blank answers are empty answers; null questions have no language and no words to copy;
* each pair has the one defect whose score lies furthest above its threshold, or none; ties go to the first of DEFECTS;
* very short and off-topic answers are no defects; texts are used whole; extra columns are ignored;
* with no or few pairs to train on, the synthetic defects of built-in answers stand in for those of the corpus.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riftlens.session import checkpointed

DEFECTS = ("empty_answer", "copied_question", "refusal", "other_language", "truncated_answer")
TRAIN_PAIRS = 3000
BITS = 14
SEED = 11

#: Words that are frequent in one language and rare in the others.
FUNCTION_WORDS = {
    "en": "the and is of to that was for with this it be not are from have has so but when if which who what why does do should could would can cannot there here one more only yes no twice once line before after between by an than them they its your you we i'm i am please answer in english about on will won't can't".split(),
    "de": "der die das und ist nicht ein eine einen dem den des zu mit auch auf aus für von wird wurde werden da wenn was warum darf muss können wir ja nein nur zweimal einmal zeile vor nach zwischen bei ich sie es gibt noch aber dass daher leider bitte antworten deutsch im am kann über nichts fragen diese dieser diesem keine keinen".split(),
    "fr": "le la les et est pas un une des du de dans pour avec que qui quoi pourquoi peut on il elle ne se sur sans aux au si oui non seulement deux fois une ligne avant après entre par je nous vous ce cette car en plus aussi désolé répondre français merci veuillez puisque donc rien ici cas l'appelant".split(),
    "es": "el la los las y es no un una del de en para con que qué por se sin si sí solo dos veces una vez línea antes después entre yo lo le al cuando está están ambos cubren puede podríamos vale también pasa falla demás así aquí ya perdón perdone responda español gracias favor hay más esta este porque llega".split(),
}
ASKED = {
    "en": ("english", "englisch", "anglais", "inglés", "ingles", "영어"),
    "de": ("german", "deutsch", "allemand", "alemán", "aleman", "독일어"),
    "fr": ("french", "französisch", "français", "francais", "francés", "frances", "프랑스어"),
    "es": ("spanish", "spanisch", "espagnol", "español", "espanol", "castellano", "스페인어"),
    "ko": ("korean", "koreanisch", "coréen", "coreano", "한국어"),
}
ASKING = re.compile(r"(?i)\b(?:answer|reply|respond|write|antwort\w*|répond\w*|repond\w*|respond\w*|contest\w*)\b|답변|답해|대답|써 주")

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_CODE = re.compile(r"`[^`\n]*`|\[[^\]\n]*\]\([^)\n]*\)|\b[\w.-]+(?:/[\w.-]+)+|\b[a-z]+[A-Z]\w*|\b\w+_\w+\b|\b\w+\.(?:go|java|rs|kt|py|js|ts)\b")
_QUOTE = re.compile(r"(?m)^[ \t]*>[^\n]*(?:\n|\Z)")
_LEAD = re.compile(r"(?i)^\W*(?:you asked|your question(?: was)?|question|ihre frage(?: war)?|frage|votre question(?: était)?|vous avez demandé|usted preguntó|su pregunta(?: fue)?|pregunta|질문하신 내용|질문)\s*[:：]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*", re.U)
_BLANK = re.compile(r"(?i)^[\W_]*(?:n/?a|none|null|nil|undefined|no content|no answer|no response|empty|tbd|leer|kein inhalt|vide|vacío|없음)?[\W_]*$")
_DIGITS = re.compile(r"\d+")
_ELISION = re.compile(r"\b(?:[ldns]|qu)'")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")


def _unquoted(answer: str) -> str:
    return _LEAD.sub("", _QUOTE.sub("", answer) if ">" in answer else answer)


def masked(text: str) -> str:
    """The prose of a text: code, paths and names of code out, digits as 9."""
    if "```" in text:
        text = _FENCE.sub(" ", text)
    return _DIGITS.sub("9", _CODE.sub(" ", text))


@lru_cache(maxsize=1)
def _lexicon() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in set(words):
            out[w] = (*out.get(w, ()), lang)
    return out


def language(text: str) -> str:
    """en, de, fr, es, ko, or empty where the prose does not tell."""
    prose = masked(text).lower().replace("’", "'")
    return _language(prose, _WORD.findall(prose))


def _language(prose: str, words: list[str]) -> str:
    """The language of masked prose in lower case and its words."""
    votes = dict.fromkeys(FUNCTION_WORDS, 0.0)
    lexicon = _lexicon()
    if not prose.isascii():
        hangul = len(re.findall("[가-힣]", prose))
        if hangul and hangul * 4 >= len(re.findall(r"[^\W\d_]", prose)):
            return "ko"
        votes["de"] += 0.7 * sum(map(prose.count, "äöüß"))
        votes["es"] += 0.7 * sum(map(prose.count, "ñ¿¡íóú"))
        votes["fr"] += 0.7 * sum(map(prose.count, "èêçàùœ"))
    if "'" in prose:
        votes["fr"] += 0.7 * len(_ELISION.findall(prose))
        words = [p for w in words for p in ((w, *w.split("'")) if "'" in w else (w,))]
    for w in words:
        for lang in lexicon.get(w, ()):
            votes[lang] += _SHARES[w]
    best = sorted(votes, key=lambda x: (-votes[x], x))
    return best[0] if votes[best[0]] >= 0.9 and votes[best[0]] >= 1.3 * votes[best[1]] else ""


def asked(question: str) -> str:
    """The language that a question asks for, or empty."""
    for sentence in re.split(r"(?<=[.!?。])\s+|\n", question.lower()):
        if ASKING.search(sentence):
            for lang, names in ASKED.items():
                if any(n in sentence for n in names):
                    return lang
    return ""


#: The vote of a function word is shared by the languages that have it.
_SHARES = {w: 1.0 / sum(w in ws for ws in FUNCTION_WORDS.values()) for ws in FUNCTION_WORDS.values() for w in ws}

ENDS = ("none", "sentence", "fence", "item", "mark", "open_fence", "open_code", "ellipsis", "colon", "bare", "fragment")


def end_of(answer: str) -> str:
    """How an answer ends."""
    text = answer.rstrip()
    if not text:
        return "none"
    if text.count("```") % 2:
        return "open_fence"
    if text.endswith("```"):
        return "fence"
    if re.search(r"(?:…|\.\.\.|\[…\]|\(…\)|[\[(]\s*\.\.\.\s*[\])])$", text):
        return "ellipsis"
    plain = _FENCE.sub(" ", text).rstrip()
    if plain.split("\n")[-1].count("`") % 2:
        return "open_code"
    last = text.split("\n")[-1]
    if re.search(r"[.!?。？！][\"'”»’)\]*_]*$", last):
        return "sentence"
    if re.search(r"[`)\]]$", last):
        return "item" if _ITEM.match(last) else "mark"
    if re.search(r"[,;:–—-]$", last):
        return "colon"
    if _ITEM.match(last):
        return "bare"
    return "fragment"


PAIR_FEATURES = 26


class _Hashes(dict):
    """Word -> hash, filled as words come; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode())
        return h


_HASHES = _Hashes()
_MASK = (1 << BITS) - 1


def _grams(words: list[str]) -> np.ndarray:
    """Distinct hashed positions of the words, pairs and triples of a text."""
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    two = h[:-1] * np.uint64(0x9E3779B1) + h[1:] + np.uint64(7)
    three = two[:-1] * np.uint64(0x85EBCA77) + h[2:] + np.uint64(13)
    at = np.concatenate((h, two ^ (two >> np.uint64(17)), three ^ (three >> np.uint64(17))))
    return np.unique((at & np.uint64(_MASK)).astype(np.int64))


def features(question: str | None, answer: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram positions (distinct, sorted) and the dense pair features."""
    question, answer = question or "", answer or ""
    body = _unquoted(answer)
    q = _WORD.findall(question.lower())
    a = _WORD.findall(body.lower())
    full = a if len(body) == len(answer) else _WORD.findall(answer.lower())
    blank = not full or len(answer) < 40 and bool(_BLANK.match(answer))
    own = set(zip(["^", *q], [*q, "$"], strict=True))
    within = sum(map(own.__contains__, zip(["^", *a], [*a, "$"], strict=True))) / (len(a) + 1) if a else 0.0
    # what is left of the answer beyond its question, quotes and lead-in taken as copies
    rest, n = a, len(q)
    if n and len(a) >= n and q[0] in a:
        at = next((i for i in range(len(a) - n + 1) if a[i] == q[0] and a[i : i + n] == q), -1)
        rest = a if at < 0 else a[:at] + a[at + n :]
    distinct = set(q)
    copied = bool(full) and not rest and (len(a) > 0 or distinct.issuperset(full) and len(full) * 2 > n)
    covers = len(distinct.intersection(full)) / len(distinct) if copied and q else 0.0
    prose = masked(body).lower().replace("’", "'")
    words = _WORD.findall(prose)
    lq, la, want = language(question), _language(prose, words) if a else "", asked(question)
    other = bool(lq and la and la != lq and la != want)
    end = end_of(answer)
    whole = not blank and not copied
    dense = [
        1.0, float(blank), float(copied), float(within > 0.8 and not blank), within if whole else 0.0, covers, min(len(rest), 30) / 30, float(0 < len(rest) <= 4),
        float(other and whole), float(bool(want) and la == want), float(la == "" and whole), float(whole and not other),
        *(float(end == e and whole) for e in ENDS), float(len(body) != len(answer) and ">" in answer), float("```" in answer), float(answer != answer.strip()),
    ]
    grams = ["^", *words, "$"]
    at = _grams(grams)
    if la == "ko":
        at = np.unique(np.concatenate((at, _grams([*("k:" + w[-3:] for w in grams), *("k:" + w[:2] for w in grams)]))))
    return at, np.asarray(dense)


# what refusals are made of, by language: openings, what is declined, closings
REFUSALS = {
    "en": (
        ("", "", "Sorry, ", "I'm sorry, but ", "I am sorry, but ", "Unfortunately ", "I apologise, but ", "I apologize, but ", "Thanks for asking, but ", "Regrettably, ", "I'm afraid "),
        ("I can't comment on {code}", "I cannot help with that request", "I can't help with this", "I am not able to answer questions about this code", "I won't be able to assist with this one", "I must decline to review {path}", "reviewing {path} is not something I can do", "I have to pass on this question about the {word}", "that is outside what I may answer", "this request falls outside what I am allowed to discuss", "that is something I'd rather not comment on", "I do not have permission to look at {path}", "I'm not allowed to share details about {code}", "as an assistant I have no access to the repository, so I must decline", "I have no access to this project and cannot answer", "I would prefer not to answer this", "it is against policy for me to discuss the {word}", "I am unable to assist with this request", "I refuse to answer that"),
        ("", "", "", " under the current policy", "; a maintainer of {path} will know", "; please ask a maintainer", ". Please ask a maintainer", ". Is there anything else I can do?", "; please contact the team", ". Please ask the team"),
    ),
    "de": (
        ("", "", "Leider ", "Es tut mir leid, ", "Tut mir leid, ", "Entschuldigung, ", "Bedauerlicherweise "),
        ("kann ich zu {code} nichts sagen", "muss ich diese Frage zu {word} ablehnen", "darf ich {path} nicht bewerten", "diese Frage möchte ich nicht beantworten", "dabei kann ich nicht helfen", "zu diesem Code darf ich keine Auskunft geben", "zu diesem Code darf ich leider keine Auskunft geben", "ich habe keinen Zugriff auf das Projekt und muss daher ablehnen", "das liegt außerhalb dessen, was ich besprechen darf", "ich kann diese Anfrage nicht bearbeiten", "darüber darf ich nicht sprechen", "ich darf dazu keine Angaben machen", "bei dieser Anfrage kann ich nicht weiterhelfen"),
        ("", "", "", " und bitte um Verständnis", "; fragen Sie bitte das Team", ". Bitte wenden Sie sich an das Team", ". Kann ich sonst etwas tun?"),
    ),
    "fr": (
        ("", "", "Désolé, ", "Je suis désolé, ", "Malheureusement, ", "Je regrette, ", "Pardon, mais "),
        ("je ne peux rien dire sur {code}", "je dois refuser d'examiner {path}", "cette question sort de mon cadre", "je ne peux pas répondre à cette demande", "je ne suis pas autorisé à commenter ce code", "sans accès au dépôt, il m'est impossible de vous aider", "je préfère ne pas me prononcer là-dessus", "je n'ai pas accès au projet et dois décliner", "je ne peux pas vous aider pour cette demande", "il m'est interdit d'en parler", "je dois décliner cette question sur {word}"),
        ("", "", "", ", veuillez demander à l'équipe", "; demandez à l'équipe", ". Veuillez vous adresser à l'équipe"),
    ),
    "es": (
        ("", "", "Lo siento, ", "Lo siento, pero ", "Por desgracia, ", "Lamentablemente, ", "Disculpe, "),
        ("no puedo opinar sobre {code}", "debo negarme a revisar {path}", "esa pregunta queda fuera de lo que puedo tratar", "no me está permitido comentar este código", "no tengo acceso al repositorio y debo declinar la pregunta", "prefiero no opinar sobre esto", "no puedo ayudar con esa petición", "no puedo responder a esta pregunta", "no estoy autorizado a hablar de {word}", "tengo que rechazar esta solicitud sobre {word}"),
        ("", "", "", "; pregunte al equipo", "; consulte con el equipo", ". Consulte con el equipo"),
    ),
    "ko": (
        ("", "", "죄송합니다. ", "죄송하지만 ", "유감스럽지만 ", "안타깝지만 "),
        ("{code} 함수에 대해서는 말씀드릴 수 없습니다", "{path} 파일은 검토해 드릴 수 없습니다", "이 코드에 대해서는 답변드릴 수 없습니다", "이 요청은 도와드릴 수 없습니다", "저장소에 접근할 수 없어 답변을 거절하겠습니다", "이 질문에는 답하지 않겠습니다", "{word} 관련 질문은 제가 다룰 수 있는 범위를 벗어납니다", "그 내용은 논의할 수 없습니다", "허용되지 않은 질문이라 답변을 드리지 못합니다"),
        ("", "", "", ". 담당자에게 문의해 주세요", ". 팀에 문의해 주세요"),
    ),
}
#: Answers that stand in where the corpus has too few.
BUILT_IN = (
    ("Does the limit also hold here?", "Yes, the caller trims the list before this line, so the limit holds for both cases."),
    ("Warum kehrt die Funktion so früh zurück?", "Die Abfrage davor verhindert, dass ein leerer Wert weitergegeben wird."),
    ("Que devient la valeur si la ligne échoue ?", "L'ancien état est conservé et le passage suivant reprend la valeur."),
    ("¿Qué pasa si falla la línea?", "Se conserva el estado anterior y la siguiente ejecución lo retoma."),
    ("이 줄에서 실패하면 값은 어떻게 되나요?", "이전 상태가 유지되고 다음 실행에서 다시 처리합니다."),
)


def _refusal(rng: random.Random, lang: str) -> str:
    openings, cores, closings = REFUSALS[lang]
    word = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))
    core = rng.choice(cores)
    opening = rng.choice(openings)
    text = (opening + core if opening else core[:1].upper() + core[1:]) + rng.choice(closings)
    text = text.format(code=f"`{word}{word.title()}`", path=f"{word}/{word}.{rng.choice(('go', 'py', 'kt', 'rs'))}", word=word)
    return text if text[-1] in ".?!" else text + "."


def _cut(rng: random.Random, answer: str) -> str | None:
    text = answer.rstrip()
    ends = [m.end() for m in re.finditer(r"[.!?。`]", text)]
    if len(text) < 25:
        return None
    style = rng.random()
    if style < 0.12:
        return text + rng.choice(("\n```go\nif err != nil {\n\treturn x", "\n```\nfor i in range(", "\n```py\ndef f(x):"))
    at = next((i for i in (rng.randrange(12, len(text)) for _ in range(20)) if i not in ends and text[i - 1 : i].isalnum()), 0)
    if not at:
        return None
    piece = text[:at]
    if piece.count("```") % 2 == 0 and style > 0.9:
        piece += rng.choice(("\n\n- `name", "\n- `a/b", "\n\n1. `x"))
    elif style > 0.65:
        piece = piece.rstrip() + rng.choice(("…", "...", " [...]", " …", " ..."))
    return piece


def _copy(rng: random.Random, question: str) -> str:
    lead = rng.choice(("", "", "> ", "You asked: ", "Question: ", "  "))
    text = question
    if rng.random() < 0.2:
        text = text.lower()
    if rng.random() < 0.2:
        text = text.rstrip("?？ ").rstrip()
    if rng.random() < 0.2:
        text = text.replace(" ", "  ")
    return lead + text + rng.choice(("", "", "\n", "\n\n"))


#: Short whole answers; they are no defect.
SHORT = {
    "en": ("Yes.", "No.", "Only `x`.", "No, only line 9.", "Twice.", "Once, in a/b.go.", "9."), "de": ("Ja.", "Nein.", "Nur `x`.", "Nein, nur Zeile 9.", "Zweimal."), "fr": ("Oui.", "Non.", "Seulement `x`.", "Non, seulement la ligne 9."),
    "es": ("Sí.", "No.", "Solo `x`.", "No, solo la línea 9."), "ko": ("네.", "아니요.", "9번째 줄만 해당합니다."),
}


def _whole(rng: random.Random, question: str, answer: str) -> str:
    """Another whole answer to the question: short, with the question quoted, with code or with a list of places."""
    style = rng.randrange(4)
    if style == 0:
        return rng.choice(SHORT.get(language(question) or "en", SHORT["en"]))
    if style == 1:
        return f"> {question}\n\n{answer}"
    if style == 2:
        return answer + rng.choice(("\n```go\nif x {}\n```", "\n```\nreturn x\n```", "\n```py\nx = 1\n```"))
    return rng.choice((answer, "See these:")) + "".join(f"\n- `a/b{i}.go:{i}`" for i in range(1, rng.randint(2, 5)))


def synthesize(pairs: list[tuple[str, str]], seed: int = SEED) -> list[tuple[str, str, int]]:
    """(question, answer, defect number or -1): the pairs as they are, whole variants and defects made of them."""
    rng = random.Random(seed)
    by_lang: dict[str, list[str]] = {}
    for _, a in pairs:
        by_lang.setdefault(language(a), []).append(a)
    langs = sorted(x for x in by_lang if x)
    out: list[tuple[str, str, int]] = []
    for q, a in pairs:
        out.append((q, a, -1))
        if end_of(a) in ("sentence", "fence", "item", "mark"):
            out.append((q, _whole(rng, q, a), -1))
        lang = language(q) or "en"
        out.append((q, _copy(rng, q), 1))
        out.append((q, _refusal(rng, lang), 2))
        others = [x for x in langs if x not in (lang, asked(q))]
        if others and language(q):
            out.append((q, rng.choice(by_lang[rng.choice(others)]), 3))
        if cut := _cut(rng, a):
            out.append((q, cut, 4))
        if rng.random() < 0.3:
            out.append((q, rng.choice(("", " ", "\n\n", "-", "—", "…", "n/a", "N/A", "> ", "(no content)", "​", "\xa0", "...", "```\n```", "none")), 0))
    return out


def _fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, seed: int = SEED) -> np.ndarray:
    """Weights (features x defects) of logistic regression by AdaGrad."""
    dense = 1 << BITS
    w = np.zeros((dense + PAIR_FEATURES, len(DEFECTS)))
    g2 = np.full_like(w, 1e-2)
    order = np.random.default_rng(seed)
    target = np.eye(len(DEFECTS))
    tail = np.arange(dense, dense + PAIR_FEATURES)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            scale = 1.0 / np.sqrt(max(len(at), 1))
            z = w[at].sum(0) * scale + x @ w[dense:]
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            err = p - (target[label] if label >= 0 else 0.0)
            for idx, grad in ((at, np.broadcast_to(err * scale, (len(at), len(err)))), (tail, np.outer(x, err))):
                grad = grad + 1e-5 * w[idx]
                g2[idx] += grad * grad
                w[idx] -= 0.25 * grad / np.sqrt(g2[idx])
    return w


def scores(w: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    return w[at].sum(0) / np.sqrt(max(len(at), 1)) + x @ w[1 << BITS :]


def _thresholds(w: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Per defect the score that best parts it from the rest where whole answers weigh ten times as much as made defects."""
    z = np.array([scores(w, at, x) for at, x, _ in rows])
    labels = np.array([label for *_, label in rows])
    out = np.zeros(len(DEFECTS))
    for k in range(len(DEFECTS)):
        weight = np.where(labels == k, 1.0, np.where(labels < 0, 10.0, 1.0))
        order = np.argsort(-z[:, k], kind="stable")
        gain = np.cumsum(np.where(labels[order] == k, 1.0, -weight[order]))
        best = int(np.argmax(gain)) if len(gain) else 0
        above = z[order[best], k] if len(gain) else 0.0
        below = z[order[best + 1], k] if best + 1 < len(gain) else above - 1.0
        out[k] = (above + below) / 2
    return out


def train(pairs: list[tuple[str, str]], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from pairs that are mostly whole."""
    if len(pairs) < 200:
        pairs = [*pairs, *BUILT_IN * 40]
    pairs = sorted((q or "", a or "") for q, a in pairs)
    rows = [(*features(q, a), label) for q, a, label in synthesize(pairs, seed)]
    split = np.random.default_rng(seed).random(len(rows))
    part = [r for r, s in zip(rows, split, strict=True) if s < 0.8]
    first = _fit(part, 2, seed)
    clean = lambda rs: [r for r in rs if r[2] >= 0 or scores(first, r[0], r[1]).max() < 0]
    w = _fit(clean(part), 4, seed)
    return w, _thresholds(w, clean([r for r, s in zip(rows, split, strict=True) if s >= 0.8]))


ASSISTANT = ("ai", "assistant", "bot", "model", "aiassistant", "agent", "copilot")


def pairs_of(turns: DataFrame) -> DataFrame:
    """thread_id, question_seq, question, answer; joined on (thread, place), so a long thread is spread."""
    last = F.max_by(F.struct("author", "text", "kind"), F.struct("received_at", F.xxhash64("author", "text", "kind")))
    once = turns.where("thread_id is not null and msg_seq is not null").groupBy("thread_id", "msg_seq").agg(last.alias("t")).select("thread_id", "msg_seq", "t.*")
    questions = once.where("kind = 'question'").select("thread_id", F.col("msg_seq").alias("question_seq"), F.col("text").alias("question"), (F.col("msg_seq") + 1).alias("__next"))
    name = F.regexp_replace(F.lower("author"), r"[^\p{L}]", "")
    answers = once.where(name.isin(*ASSISTANT)).select(F.col("thread_id").alias("__thread"), F.col("msg_seq").alias("__at"), F.col("text").alias("answer"))
    joined = questions.join(answers, (F.col("thread_id") == F.col("__thread")) & (F.col("__next") == F.col("__at")))
    return joined.select("thread_id", "question_seq", "question", "answer")


def defects(turns: DataFrame, train_pairs: int = TRAIN_PAIRS, seed: int = SEED) -> DataFrame:
    """thread_id, question_seq, defect (null where there is none) of every pair."""
    # kept, as they are fitted and scored
    pairs = checkpointed(pairs_of(turns))
    sample = pairs.where("length(trim(answer)) > 0").orderBy(F.xxhash64("thread_id", "question_seq"), "thread_id", "question_seq").select("question", "answer").limit(train_pairs)
    w, at_least = train([(r[0], r[1]) for r in sample.collect()], seed)
    w32 = w.astype(np.float32)

    @pandas_udf("string")
    def judge(questions: pd.Series, answers: pd.Series) -> pd.Series:
        out = []
        for q, a in zip(questions, answers, strict=True):
            margin = scores(w32, *features(q, a)) - at_least
            k = int(np.argmax(margin))
            out.append(DEFECTS[k] if margin[k] > 0 else None)
        return pd.Series(out, dtype="object")

    return pairs.select("thread_id", "question_seq", judge("question", "answer").alias("defect"))
