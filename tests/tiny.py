"""Small corpora written out by hand: {"A": [text, ...]}, a text being a list of sentences of words."""

from __future__ import annotations

from datetime import datetime

from quillspan.sources.corpora import Corpora

SENTENCES = (
    "corpus string, text_id bigint, text_name string, sent_no int, sent_off bigint, n int, text_n bigint, word array<string>, "
    "pos array<string>, lex array<array<string>>, words_before array<string>, words_after array<string>, "
    "datefrom timestamp_ntz, dateto timestamp_ntz"
)
TEXTS = "corpus string, text_id bigint, text_name string, n_tokens bigint, n_sents bigint, start_pos bigint, datefrom timestamp_ntz, dateto timestamp_ntz"
REGIONS = "corpus string, kind string, no bigint, text_id bigint, off bigint, first bigint, last bigint, value string"
INFO = "corpus string, size bigint, sentences bigint, texts bigint, first_date timestamp_ntz, last_date timestamp_ntz"


def day(text):
    return None if text is None else datetime.fromisoformat(text)


def tiny(spark, corpora, lex=None, dates=None, names=None, inside=None, across=None):
    """``lex`` maps a word to its value set, ``dates`` and ``names`` a (corpus, text number) to its span and name.

    ``inside`` and ``across`` map a kind of region to ``(corpus, first, last)``, positions in the corpus.
    """
    lex, dates, names, inside, across = lex or {}, dates or {}, names or {}, inside or {}, across or {}
    sents, texts, info, regions = [], [], [], []
    for corpus, content in corpora.items():
        start = 0
        for text_id, text in enumerate(content):
            flat = [w for s in text for w in s]
            span = tuple(day(d) for d in dates.get((corpus, text_id), (None, None)))
            name = names.get((corpus, text_id))
            off = 0
            for no, s in enumerate(text):
                pos = ["U" if w[:1].isupper() else "L" for w in s]
                before, after = flat[max(off - 3, 0) : off], flat[off + len(s) : off + len(s) + 3]
                sents.append((corpus, text_id, name, no, off, len(s), len(flat), s, pos, [lex.get(w, [w]) for w in s], before, after, *span))
                off += len(s)
            texts.append((corpus, text_id, name, len(flat), len(text), start, *span))
            start += len(flat)
        own = [t for t in texts if t[0] == corpus]
        firsts, lasts = [t[6] for t in own if t[6]], [t[7] for t in own if t[7]]
        info.append((corpus, start, sum(len(t) for t in content), len(content), min(firsts, default=None), max(lasts, default=None)))
    for kind, places in {**inside, **across}.items():
        seen = {}
        for corpus, first, last in sorted(places):
            text = max((t for t in texts if t[0] == corpus and t[5] <= first and t[3]), key=lambda t: t[5])
            group = (corpus, text[1]) if kind in inside else corpus
            no = seen[group] = seen.get(group, -1) + 1
            regions.append((corpus, kind, no, text[1], first - text[5], first, last, f"{kind}{no}"))
    return Corpora(
        spark.createDataFrame(sents, SENTENCES).repartition(3),
        spark.createDataFrame(texts, TEXTS).repartition(2),
        spark.createDataFrame(info, INFO),
        ("word", "pos", "lex"),
        ("text_name",),
        regions=spark.createDataFrame(regions, REGIONS) if regions else None,
        inside=tuple(inside),
        across=tuple(across),
    )
