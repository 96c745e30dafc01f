"""Kana in Latin letters, by the Hepburn rules, without marks of long vowels."""

from __future__ import annotations

import re

_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
_SPECIAL = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "o", "ん": "n", "ゔ": "vu"}
_SYLLABLE = {kana: c + v for c, row in _ROWS.items() for kana, v in zip(row, "aiueo", strict=True)} | _SPECIAL
_GLIDE = dict(zip("ゃゅょ", ("ya", "yu", "yo"), strict=True))
_SMALL = dict(zip("ぁぃぅぇぉ", "aiueo", strict=True))
_BP, _M = _ROWS["b"] + _ROWS["p"], _ROWS["m"]
KANA = re.compile("[ぁ-ゖァ-ヺー]+")


def _syllable(first: str, small: str) -> str:
    """A kana with a small one after it."""
    whole = _SYLLABLE.get(first, first)
    if small in _GLIDE:
        stem = whole[:-1]
        return stem + _GLIDE[small][1:] if stem in ("sh", "ch", "j") else stem + _GLIDE[small]
    stem = whole[:-1] or ("w" if first == "う" else "")
    return (stem if stem != "ts" else "ts") + _SMALL[small]


def to_latin(text: str) -> str:
    """Runs of kana in Latin letters, long vowels short; other characters stay.

    The syllabic n is an m before b and p; before m it is one in katakana, which write foreign
    words, while hiragana readings join words there (Namba, Tenma).
    """

    def run(m: re.Match) -> str:
        kana = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in m[0])
        out, i, double = "", 0, False
        while i < len(kana):
            c, nxt = kana[i], kana[i + 1 : i + 2]
            if c in "っ":
                double, i = True, i + 1
                continue
            if c == "ー":
                i += 1
                continue
            two = bool(nxt) and (nxt in _GLIDE or nxt in _SMALL) and c in _SYLLABLE
            s = _syllable(c, nxt) if two else _SYLLABLE.get(c, _SMALL.get(c, c))
            if c == "ん" and (nxt in _BP or (nxt in _M and m[0][i] == "ン")) and nxt:
                s = "m"
            out += ("t" if s.startswith("ch") else s[:1] if double else "") + s if double else s
            i, double = i + 1 + two, False
        return out.replace("ou", "o").replace("uu", "u")

    return KANA.sub(run, text)
