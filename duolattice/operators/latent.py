"""Features of single edits in their context: names of what an alignment's step shows, before any weights.

A generator sees the history (the parts of the path up to and with this step; a part is operation name, source phrase, target
phrase), and the positions before and after the step. It returns the set of its feature names.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

#: Markers and separators within feature names.
BEGIN, END, EPSILON, PHRASE, PART, OP, WORD = "^", "$", "-", "+", "_", ">", "~"
Part = tuple[str, str, str]


def class_patterns(vowels: str) -> tuple[str, str]:
    """Patterns of consonants (anything but vowels, ASCII punctuation and white space) and of vowels."""
    return f"[^{re.escape(string.punctuation)}{vowels}\\s]", f"[{vowels}]"


def vowel_classes(text: str, vowels: str) -> str:
    """Consonants as [C], then vowels as [V], in either case."""
    consonant, vowel = class_patterns(vowels)
    return re.sub(vowel, "[V]", re.sub(consonant, "[C]", text, flags=re.I), flags=re.I)


@dataclass(frozen=True)
class WordAlignment:
    """State n-grams S:, alignment n-grams A: and C: (without epsilons), windows W:, and bigrams Bi:."""

    order: int = 0
    align_ngrams: bool = True
    align_unigrams_only: bool = False
    collapsed_ngrams: bool = True
    state_ngrams: bool = True
    state_unigrams_only: bool = False
    bigrams: bool = False
    window: int = 0
    vowels: str = ""
    normalize: bool = True

    @property
    def positional(self) -> bool:
        """Whether features depend on more than the history."""
        return self.window > 0 or self.bigrams

    def _backoff(self, name: str) -> list[str]:
        """The name, and with known vowels also its vowel and consonant classes."""
        if not self.vowels:
            return [name]
        kind, _, body = name.partition(":")
        return [name, f"{kind}:{vowel_classes(body, self.vowels)}"]

    def names(self, history: list[Part], source: list[str], target: list[str], i_prev: int, j_prev: int, i: int, j: int, no_op: bool) -> set[str]:
        out: set[str] = set()
        recent = history[-(self.order + 1) :]
        suffixes = [recent[-n:] for n in range(1, len(recent) + 1)]
        if self.state_ngrams:
            out |= {"S:" + OP.join(p[0] for p in s) for s in suffixes if len(s) == 1 or not self.state_unigrams_only}
        if len(history) > 1:
            for s in suffixes:
                n = len(s)
                if self.align_ngrams and (n == 1 or not self.align_unigrams_only) and (n > 1 or not no_op):
                    out |= {*self._backoff("A:" + PART.join(p[1] + OP + p[2] for p in s))}
                gaps = any(EPSILON in p[1:] for p in s)
                if self.collapsed_ngrams and not self.align_unigrams_only and self.order > 0 and gaps and not (self.align_ngrams and n == 1):
                    # Every kept phrase is followed by the separator, the last one too.
                    a, b = ("".join(p[k] + PART for p in s if p[k] != EPSILON) for k in (1, 2))
                    out |= {*self._backoff("C:" + a + OP + b)}
        _, mine, other = history[-1]
        around = lambda seq, before, after, phrase, n: PHRASE.join([*(seq[before - k] if before - k >= 0 else BEGIN for k in range(n, 0, -1)), phrase, *(seq[after + k] if after + k < len(seq) else END for k in range(n))])
        for n in range(1, self.window + 1):
            out.add("W:" + around(source, i_prev, i, mine, n) + OP + around(target, j_prev, j, other, n))
        if self.bigrams:
            if mine != EPSILON:
                out.add("Bi:" + mine + PHRASE + (source[i] if i < len(source) else END) + OP + other)
            if other != EPSILON:
                out.add("Bi:" + mine + OP + other + PHRASE + (target[j] if j < len(target) else END))
        return out

    @staticmethod
    def default_weight(feature: str, label: int) -> float:
        """A first guess: what speaks for a match is positive for label 1, the latest step counts most."""
        if label not in (0, 1):
            return 0.0
        sign = 1.0 if label == 1 else -1.0
        kind, *parts = [p for p in re.split("[_:>]", feature) if p]
        if kind == "Bias":
            return sign
        if kind == "A":
            good = [a == b for a, b in zip(parts[::2], parts[1::2])]
        elif kind == "S":
            good = [p.lower().startswith("mat") for p in parts]
        elif kind == "E" and parts:
            op = parts[0].lower()
            if op.startswith("no"):
                return 0.0
            same = op.startswith("mat") or op.startswith("rep") and len(parts) > 2 and parts[1] == parts[2]
            return sign if same else -sign
        else:
            return 0.0
        value = 0.0
        for g in good:
            value = value / 3 + (sign if g else -sign) * 2 / 3
        return value


@dataclass(frozen=True)
class SentenceAlignment:
    """S: as above, and for each indicator of the tokens (word~f1~f2...) an n-gram A: of what goes with what."""

    order: int = 0
    align_ngrams: bool = True
    align_unigrams_only: bool = False
    state_ngrams: bool = True
    normalize: bool = True
    positional = False

    def names(self, history: list[Part], source: list[str], target: list[str], i_prev: int, j_prev: int, i: int, j: int, no_op: bool) -> set[str]:
        recent = history[-(self.order + 1) :]
        suffixes = [recent[-n:] for n in range(1, len(recent) + 1)]
        out = {"S:" + OP.join(p[0] for p in s) for s in suffixes} if self.state_ngrams else set()
        if no_op or not self.align_ngrams:
            return out
        _, mine, other = history[-1]
        split = lambda phrase: [[f for f in t.split(WORD) if f][1:] for t in phrase.split(PHRASE) if t]
        n_features = len(split(mine if mine != EPSILON else other)[0])
        for f in range(n_features):
            left = right = name = ""
            for n, (_, a, b) in enumerate(reversed(recent), 1):
                # What was read of later parts stays before that of earlier ones; an epsilon wipes it.
                left = EPSILON if a == EPSILON else left + "".join(t[f] + PHRASE for t in split(a))
                right = EPSILON if b == EPSILON else right + "".join(t[f] + PHRASE for t in split(b))
                name = left + OP + right + name
                if n == 1 or not self.align_unigrams_only:
                    out.add("A:" + name)
                name = PART + name
        return out

    @staticmethod
    def default_weight(feature: str, label: int) -> float:
        return 0.0


@dataclass(frozen=True)
class NoLatent:
    """No features on edits: models then look at pairs only through observed features."""

    order: int = 0
    normalize: bool = False
    positional = False

    def names(self, *_) -> set[str]:
        return set()

    @staticmethod
    def default_weight(feature: str, label: int) -> float:
        return 0.0


#: Generators by name.
LATENT = {"WordAlignment": WordAlignment, "SentenceAlignment": SentenceAlignment, "Empty": NoLatent}
