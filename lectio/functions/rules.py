"""Fixed values of the text analysis: stop words and suffix tables of the stemmer."""

# Words that are not indexed.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "not", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "as",
    "be", "was", "were", "been", "are", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "this", "that", "these", "those", "i", "you", "he", "she", "we", "they", "me",
    "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "what", "which", "who", "whom", "how",
    "when", "where", "why", "if", "then", "so", "no", "yes", "about", "up", "out", "just", "into", "over", "after",
)

# Suffix and replacement; the first suffix that matches decides, if the stem before it has a measure above 0.
DOUBLE_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
NOUN_SUFFIXES = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))

# Suffixes that fall off where the measure before them is above 1; each one is tried in turn.
LAST_SUFFIXES = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

#: What separates tokens.
SEPARATORS = r"[^a-z0-9\-]+"
#: Measure (consonant-vowel changes) of at least 1 and 2, a vowel, and a final consonant-vowel-consonant.
M1 = "[^aeiou][aeiouy]"
M2 = "^[aeiou]*[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou][^aeiouy]*[aeiouy]"
VOWEL = "[aeiou]|[^aeiou]y"
CVC = "([^aeiouy](yy)*|(^|[aeiou])(yy)*y)[aeiouy][^aeiouwxy]$"
#: A doubled final consonant other than l, s, z (y by its own rule).
DOUBLED_Y = "((^|[aeiou])y(yy)+|[^aeiouy](yy)+)$"
SINGLE = "aeiouylsz"
