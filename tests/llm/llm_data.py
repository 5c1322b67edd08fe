"""Made documents with labels that their texts bear out."""

from __future__ import annotations

import random


def labelled(n: int = 700):
    rng = random.Random(3)
    docs, labels = [], []
    alphabets = {"en": ["th", "er", "on", "an", "re", "he"], "de": ["sch", "ung", "ei", "ver", "ich", "zu"], "es": ["cion", "ado", "que", "os", "el", "ar"]}
    for k in range(n):
        lang = rng.choice(list(alphabets))
        words = ["".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 300))]
        good, toxic = int(rng.random() < 0.75), int(rng.random() < 0.3)
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["%%%", "&&&"]) for w in words]
        if toxic:
            for _ in range(2 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "Gr0bnik", "zzvile", "ZZVILE!"]))
        docs.append((k, " ".join(words), lang, rng.choice("ab")))
        labels.append((k, good, toxic))
    return docs, labels
