"""Fixed values.

Everything here has to equal the published value for results to agree: letters, limits, text
patterns, prompt wordings. No logic lives in this module.
"""

# Option letters and shape of a multiple-choice item.
LETTERS = ["A", "B", "C", "D", "E"]
OPTION_COUNT = 5

# How a reply without a readable answer is spelled when a caller wants text rather than null.
UNPARSED = "N/A"

# Sampling.
SAMPLE_SEED = 42
STRATIFIED_LIMIT = 1030
NESTED_SIZES = [500, 1000, 2000, 3000, 4000, 5000]

# Encoding.
MAX_INPUT_TOKENS = 512
MAX_LABEL_TOKENS = 128

# The 32 ASCII punctuation marks that the exact-match metric ignores.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Unicode white space (29 code points) and word characters, spelled so that Java's regex engine
# and RE2 read them alike.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
WORD_SPACE_COLON_BRACKET = r"[\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}:()]"
NOT_WORD_SPACE_COLON_BRACKET = r"[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}:()]"

# Answer patterns. Case is ignored in all but AFTER_PHRASE.
LAST_LETTER = (
    rf"(?:answer{SPACE}*:?|answer{SPACE}+is{SPACE}*:?"
    rf"|correct{SPACE}+option{SPACE}+is{SPACE}*:?){SPACE}*([A-E])"
)
CLEAN_COLON_LETTER = rf"answer{SPACE}*:{SPACE}*\n*{SPACE}*([a-e])"
CLEAN_IS_LETTER = rf"answer{SPACE}+is{SPACE}+([a-e])"
AFTER_PHRASE = "answer is"
STRICT_PHRASE = r"The correct answer is ([A-E])"
DIGIT_COMMA_DIGIT = r"(\p{Nd}),(\p{Nd})"
NUMBER = r"[-+]?[.]?\p{Nd}+(?:,\p{Nd}\p{Nd}\p{Nd})*[.]?\p{Nd}*(?:[eE][-+]?\p{Nd}+)?"
QUOTED_OPTION = r'"([^"]+)"'

# Paragraphs holding this phrase give the answer away and are left out of a rationale.
CLOSING_PHRASE = "The answer is:"

# Prompt wordings.
NUMERIC_INSTRUCTION = (
    "Answer the following question. At the end of your response, clearly state your answer in the "
    "format 'The answer is [value]' where the value is the numeric answer.\n"
)
STEP_INSTRUCTION = (
    "Think step by step. You must indicate the correct answer by stating 'The correct answer is "
    "[LETTER]'. You must use that format."
)
TEMPLATE_WITH_CLOSING = (
    "Below is a question and the multiple choice options. Write a response that appropriately "
    "completes the request.\n\n### Question: {prompt}\n Options: {options_text}\n\n### Response: "
    "Let's think step by step. At the end of the explanation write 'The answer is: '"
)
TEMPLATE_PLAIN = (
    "Below is a question and the multiple choice options. Write a response that appropriately "
    "completes the request.\n\n### Question: {prompt}\n Options: {options_text}\n\n### Response: "
    "Let's think step by step. "
)

# Special ids of an encoded example.
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_TOKEN_ID = 2
TOKEN_SEPARATOR = r"[ \n\t\r]+"
