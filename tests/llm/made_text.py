"""Prose of two languages for the tests."""

WORDS = {
    "en": "the of and to in is that was for it with as his on be at by had not are but from or have an they which one you were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing", "s", "x%d" % rng.randrange(40)]) for _ in range(n))
