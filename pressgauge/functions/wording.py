"""Sentences shown to the reader. Fixed values, as printf templates."""

EMPTY = "Please paste a news headline or article."
TOO_LONG = (
    "That is %,d words, and the limit is %d. Please paste the headline and the first few paragraphs."
)
NOT_ENGLISH = (
    "This tool can only read English. It has only ever been trained on English news, so on anything "
    "else it does not fail politely — it confidently calls it fake. Please paste an English article."
)
NOT_ENGLISH_PROSE = (
    "That does not look like English prose. This tool can only read English news articles — in any "
    "other language, or on random text, it will confidently call the article fake. Please paste an "
    "English article."
)
TOO_SHORT = (
    "This headline is not in our fact-check records, and at %d word%s there is not enough text for "
    "our reading model to judge it. Paste at least %d words."
)
DATABASE = "Found in our dataset of %,d articles, %s.%s The 100%% is how certain the match is."
DATABASE_BODY_NOTE = (
    " Matched on the article text — the headline you pasted is not the one we have on file."
)
READING_MODEL = (
    "Not in our dataset, so the reading model read the article itself. Verdicts like this are right "
    "%s%% of the time, measured on %,d articles it never saw in training."
)
WORD_COUNTER = (
    "Not in our dataset, so the word-counting model read the article itself. It is %s%% sure this is %s.%s"
)
CROSS_SOURCE_RECORD = (
    " To measure this, the model was tested on {test_samples:,} articles from a separate collection it "
    "never learned from, and labelled {test_accuracy}% of them correctly (measured {trained_at})."
)
SHUFFLED_RECORD = (
    " This model was trained on {training_samples:,} articles and correctly labelled {test_accuracy}% of "
    "the {test_samples:,} articles that were held back from training. Those held-back articles came from "
    "the same collections as the training ones, so treat that figure as optimistic (measured {trained_at})."
)
UNAVAILABLE = "Analysis system is not available. Please ensure the model files are present."
