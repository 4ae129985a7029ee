"""Declared schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (must equal the reference task's values for equal results).
# --------------------------------------------------------------------------
BOS = "BOS"
EOS = "EOS"
NONE_TAG = "NONE"

XPOS_TAGS = ["CC", "CD", "DT", "EX", "FW", "IN", "JJ", "JJR", "JJS", "LS", "MD", "NN", "NNS",
             "NNP", "NNPS", "PDT", "POS", "PRP", "RB", "RBR", "RBS", "RP", "SYM", "TO", "UH",
             "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "WDT", "WP", "WRB", ".", ",", "?", "!"]
UPOS_TAGS = ["ADJ", "ADP", "PUNCT", "ADV", "AUX", "SYM", "INTJ", "CCONJ", "X", "NOUN", "DET",
             "PROPN", "NUM", "VERB", "PART", "PRON", "SCONJ"]
DEPRELS = ["acl", "advcl", "advmod", "amod", "appos", "aux", "case", "cc", "ccomp", "clf",
           "compound", "conj", "cop", "csubj", "dep", "det", "discourse", "dislocated", "expl",
           "fixed", "flat", "goeswith", "iobj", "list", "mark", "nmod", "nsubj", "nummod", "obj",
           "obl", "orphan", "parataxis", "punct", "reparandum", "root", "vocative", "xcomp"]
DEPENDENCY_RELATIONS = ["governor", "child", "ancestor", "grandchild", "sibling", "sibling_child"]

DEFAULT_WINDOW = 5          # +/- words of the positional window
DEFAULT_NGRAM = 2           # n of the tag n-gram
DEFAULT_NGRAM_WINDOW = 5    # +/- start offsets of the n-gram window

# Pronoun lists of the name-gender scorer (case-sensitive membership).
SCORER_SHE = ["her", "She", "she", "Her", "hers", "Hers"]
SCORER_HE = ["him", "He", "he", "Him", "His", "his"]
# Pronoun lists of the profiling report (case-sensitive membership).
PROFILE_SHE = ["her", "She", "she", "Her"]
PROFILE_HE = ["him", "He", "he", "Him"]
# Lower-cased pronouns flagged feminine by the gender flag.
GENDER_FEMININE = ["she", "her"]

UNIFORM_P = 0.33333                     # constant scorer
UNDECIDED = (0.2, 0.2, 0.6)             # rule scorers when nothing fires
TIE = (0.5, 0.5, 0.0)                   # syntax scorer tie
MIN_PREDICTION_PROB = 0.2               # candidate-prefix scorer threshold
SYNTAX_MIN_POINTS = 4                   # syntax scorer threshold
LOGLOSS_EPS = 1e-15                     # probability clip of the log loss
CLASS_NAMES = ["A", "B", "NEITHER"]     # class 0, 1, 2

# Word-piece packing
SEQ_LENGTH = 512
CLS, SEP = "[CLS]", "[SEP]"
PAD_ID, CLS_ID, SEP_ID = 0, 101, 102
PIECE_VOCAB_SIZE = 30522

# --------------------------------------------------------------------------
# Fixed values of the mention fixture derived from the driver's `documents`.
# --------------------------------------------------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[ \t\r\n]+|[^\p{L}\p{N}_ \t\r\n]"
BLANK_START = r"^[ \t\r\n]"
SENTENCE_END = [".", "?", "!"]
NAME_PATTERN = r"^\p{Lu}\p{Ll}{2,}$"
NUM_PATTERN = r"^[0-9]+$"
PUNCT_PATTERN = r"^[^\p{L}\p{N}_]$"
ANCHORS_F = ["she", "her", "hers", "the"]
ANCHORS_M = ["he", "him", "his", "of"]
POSSESSIVE = ["her", "hers", "his"]
DEPREL_BY_IDX_MOD5 = ["nsubj", "obj", "nmod:poss", "advmod", "punct"]
XPOS_BY_UPOS = {"PRON": "PRP", "NUM": "CD", "PUNCT": ".", "PROPN": "NNP",
                "NOUN": "NN", "VERB": "VB", "ADJ": "JJ"}
PIECE_WIDTH = 4             # fixed-length word-piece split
# --------------------------------------------------------------------------

MENTION_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType(), False),
    T.StructField("Text", T.StringType(), True),
    T.StructField("Pronoun", T.StringType(), True),
    T.StructField("Pronoun-offset", T.IntegerType(), True),
    T.StructField("A", T.StringType(), True),
    T.StructField("A-offset", T.IntegerType(), True),
    T.StructField("A-coref", T.BooleanType(), True),
    T.StructField("B", T.StringType(), True),
    T.StructField("B-offset", T.IntegerType(), True),
    T.StructField("B-coref", T.BooleanType(), True),
    T.StructField("URL", T.StringType(), True),
])

MENTION_RENAMES = {
    "ID": "id", "Text": "text", "Pronoun": "pronoun", "Pronoun-offset": "pronoun_offset",
    "A": "a", "A-offset": "a_offset", "A-coref": "a_coref",
    "B": "b", "B-offset": "b_offset", "B-coref": "b_coref", "URL": "url",
}

PREDICTION_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType(), False),
    T.StructField("A", T.DoubleType(), True),
    T.StructField("B", T.DoubleType(), True),
    T.StructField("NEITHER", T.DoubleType(), True),
])

WORDS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("wi", T.IntegerType(), False),
    T.StructField("sent", T.IntegerType(), False),
    T.StructField("idx", T.IntegerType(), False),
    T.StructField("o", T.IntegerType(), True),
    T.StructField("word", T.StringType(), False),
    T.StructField("lemma", T.StringType(), True),
    T.StructField("upos", T.StringType(), True),
    T.StructField("xpos", T.StringType(), True),
    T.StructField("governor", T.IntegerType(), False),
    T.StructField("deprel", T.StringType(), True),
])
