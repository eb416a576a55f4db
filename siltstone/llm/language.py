"""Language of short texts: by script, and among Latin-script languages by function words."""

from __future__ import annotations

import re
from collections import Counter

# Function words that set the Latin-script languages apart.
FUNCTION_WORDS = {
    "en": "the and of to is in that it for with as are this on be at by from not have has was you your each its will which into what how does when we our an or can if there after before then than so let compute find give name write which who where list explain why many much should do please following work solve".split(),
    "de": "der die das und ist nicht ein eine einen einem einer zu von mit auf für dass des dem den sich wird bis alle sind im werden wie wir man am oder auch nach noch aus bei bevor etwa zwischen wenn ich sie kann darum antwort ergibt zuerst erhalten".split(),
    "fr": "le la les et est de des du un une que pas ne pour dans avec sur au aux qui il faut plus par ou si puis nous cette sont ce se en son sa vous je quand entre après avant d l qu réponse obtient ajoute abord".split(),
    "es": "el la los las y es de del un una que no por para con se al más hay lo si cada después su como en entre está sobre cuando antes pero hasta qué cuántas respuesta primero luego suma obtiene conviene".split(),
    "it": "il lo gli che di è non un una per con si della delle sono nel ma come più questo prima dopo anche".split(),
    "pt": "o os as que de não um uma para com se do da dos das em no na mais por como é são antes depois também".split(),
}
_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words):
        _OF[_w] = (*_OF.get(_w, ()), _lang)
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[一-鿿㐀-䶿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_HANGUL = re.compile(r"[가-힯]")
_ARABIC = re.compile(r"[؀-ۿ]")
_ACCENTS = {"de": re.compile("[äöüß]"), "fr": re.compile("[àâçèêëîïôûùœ]|é[est]?\\b"), "es": re.compile("[ñ¿¡áíóú]")}


def weights(text: str) -> dict[str, float]:
    """Evidence per language, about one per word (a Chinese or Japanese character counts half a word)."""
    out: dict[str, float] = {}
    if not text.isascii():
        kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
        if kana and kana * 8 >= han:
            out["ja"] = (kana + han) / 2
        elif han:
            out["zh"] = han / 2
        if n := len(_CYRILLIC.findall(text)):
            out["ru"] = n / 5
        if n := len(_HANGUL.findall(text)):
            out["ko"] = n / 2
        if n := len(_ARABIC.findall(text)):
            out["ar"] = n / 4
    low = text.lower()
    found = _WORD.findall(low)
    if not low.isascii():
        found = [w for w in found if w[0] < "ɐ"]
    if found:
        score = dict.fromkeys(FUNCTION_WORDS, 0.0)
        counts = Counter(found)
        for w in _OF.keys() & counts.keys():
            for lang in _OF[w]:
                score[lang] += counts[w]
        if not low.isascii():
            for lang, pattern in _ACCENTS.items():
                score[lang] += 1.5 * len(pattern.findall(low))
        lang = max(score, key=lambda k: score[k])
        if score[lang] >= 2 and score[lang] >= 0.12 * len(found):
            out[lang] = float(len(found))
    return out


def language(text: str) -> str | None:
    """The language of most of the text, or None where there is too little to tell."""
    got = weights(text)
    if not got:
        return None
    lang = max(got, key=lambda k: got[k])
    return lang if got[lang] >= 2 else None
