"""Corpus analytics as DataFrame-to-DataFrame functions on Spark."""

from quillspan.plans.pattern import alt, any_token, gap, look, one, rep, seq, tok
from quillspan.sources.corpora import Corpora, prepare

__all__ = ["Corpora", "alt", "any_token", "gap", "look", "one", "prepare", "rep", "seq", "tok"]
