"""Fixed word lists and character sets.

These are fixed values that must equal the published lists for the results to
match; they are written out plainly, in their natural order.
"""

# The English stop-word list distributed with NLTK's stopwords
# corpus (179 words), in the corpus file's order.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't "
    "didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't "
    "wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Whole-word splits the Treebank word tokenizer applies to
# apostrophe-free text (word -> two tokens).
TREEBANK_SPLITS = {
    "cannot": ("can", "not"),
    "gimme": ("gim", "me"),
    "gonna": ("gon", "na"),
    "gotta": ("got", "ta"),
    "lemme": ("lem", "me"),
    "wanna": ("wan", "na"),
}

# Noun detachment rules of WordNet's morphy (suffix -> replacement),
# in the order they are tried.
NOUN_DETACHMENTS = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
)

# Control-code quotes and dashes (cp1252 positions read as latin-1)
# and their ASCII replacements.
SMART_PUNCT_FROM = "\u0093\u0094\u0091\u0092\u0096\u0097"
SMART_PUNCT_TO = "\"\"''--"

# Whitespace as Python's str.split()/str.strip() see it (Unicode White_Space
# plus the four ASCII information separators).  Written as a regex class body
# that both Java regex and RE2 accept.
WS_CLASS = (r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

# ASCII punctuation (Python's string.punctuation) as a regex class body.
ASCII_PUNCT_CLASS = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
