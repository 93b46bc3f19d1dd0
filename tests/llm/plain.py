"""Plain versions of small things."""


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_phrases(text, known):
    """How many longest matches in ``known`` a greedy parse of ``text`` needs."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in known and text[at] in known:
            k += 1
        n, at = n + 1, at + k
    return n
