"""Which language a clause is written in, by script and by frequent short words."""

from __future__ import annotations

import re

#: Frequent function words of the languages that share the Latin script.
FUNCTION_WORDS = {
    "en": "the of and to a in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out then them she many some so these would other into has more two him see could no than first been its who now did get may after only my over such take any most also before under both between does nor still however because",
    "es": "el la los las de del que y en un una por con para se su no es lo como más pero sus le ya o este porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno ni contra otros ese eso ante ellos fue así al luego además mientras he son ha",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich dann also außerdem während habe beide davon dazu mir mich",
    "pt": "o a os as de do da dos das que e em um uma por com para se no na nos nas não é mais como mas foi ao ele ela seu sua ou quando muito já está eu também só pelo pela até isso entre depois sem mesmo aos seus quem me esse eles você essa num nem às depois então além enquanto dá com",
    "fr": "le la les de des du et à un une est en que qui dans pour pas sur ce il elle au aux plus par avec son sa ses ne se nous vous ils mais ou où comme tout sans peut cette ces leur dont aussi fait être puis donc était sont ai je je tandis même après avant entre deux d l qu n s j c",
    "it": "il lo la i gli le di del della dei delle che e in un una per con non è si da al alla nel nella sono come più ma anche ha se su questo questa o quando ne io molto chi dove poi dal dalla tra fra loro suo sua suoi tutto essere stato così quindi inoltre mentre perché ho due l d un",
}
#: Languages as a prompt may name them.
NAMES = {
    "en": "english inglés ingles inglês anglais englisch inglese",
    "es": "spanish español espanol castellano espanhol espagnol spanisch spagnolo",
    "de": "german alemán aleman alemão allemand deutsch tedesco",
    "pt": "portuguese portugués português portugais portugiesisch portoghese",
    "fr": "french francés francês français französisch francese",
    "it": "italian italiano italien italienisch",
    "zh": "chinese chino chinês chinois chinesisch cinese mandarin",
    "ja": "japanese japonés japonês japonais japanisch giapponese",
    "hi": "hindi",
    "ru": "russian ruso russo russe russisch",
}
SCRIPTS = (
    ("ja", re.compile(r"[぀-ヿ]")),
    ("zh", re.compile(r"[一-鿿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("ko", re.compile(r"[가-힯]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("he", re.compile(r"[֐-׿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("el", re.compile(r"[Ͱ-Ͽ]")),
)
#: Any letter of the other scripts.
_OTHER = re.compile("[" + "".join(p.pattern[1:-1] for _, p in SCRIPTS) + "]")
LATIN_LANGUAGES = tuple(FUNCTION_WORDS)
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_OF_WORD: dict[str, tuple[int, ...]] = {}
for _i, _k in enumerate(LATIN_LANGUAGES):
    for _w in _SETS[_k]:
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _i)
_WORD = re.compile(r"[^\W\d_]+")
_NAMED = {name: code for code, names in NAMES.items() for name in names.split()}
_ASKED = re.compile(r"\b(?:in|en|auf|em)\s+(" + "|".join(sorted(_NAMED, key=len, reverse=True)) + r")\b", re.I)


def scores(text: str, found: list[str] | None = None) -> tuple[dict[str, float], int]:
    """(share of the text's words or letters that speak for each language, number of words); found: the text's words in lower case, if known."""
    if found is None:
        found = _WORD.findall(text.lower())
    out: dict[str, float] = {}
    if not text.isascii():
        letters = max(1, sum(map(len, found)))
        if _OTHER.search(text):
            for code, pattern in SCRIPTS:
                n = len(pattern.findall(text))
                if n:
                    out[code] = min(1.0, n / letters)
            if "ja" in out and "zh" in out:
                out["ja"] = min(1.0, out["ja"] + out.pop("zh"))
    counts = [0.0] * len(LATIN_LANGUAGES)
    for of in filter(None, map(_OF_WORD.get, found)):
        share = 1.0 / len(of)
        for i in of:
            counts[i] += share
    n = max(1, len(found))
    for i, c in enumerate(counts):
        if c:
            out[LATIN_LANGUAGES[i]] = c / n
    return out, len(found)


def detect(text: str) -> str | None:
    """The likeliest language, or None if nothing speaks for any."""
    by, _ = scores(text)
    return max(by, key=by.get) if by else None


def asked_language(prompt: str) -> str | None:
    """The language a prompt asks its answer to be in: the one it names in its last line, else its own."""
    last = prompt.strip().rsplit("\n", 1)[-1]
    named = _ASKED.findall(last)
    return _NAMED[named[-1].lower()] if named else detect(prompt)
