"""Fixed values.

Everything here has to keep its exact value: results (prompts, file names, split
membership, run keys) depend on it.  All of them are defaults of parameters.
"""

# --- languages and text -------------------------------------------------------
LANG_C = "C"
LANG_RUST = "Rust"
ALLOWED_LANGUAGES = ("C", "Rust")
NBSP = "\xa0"

# The 29 code points for which Python's str.isspace() is true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- corpus layout ------------------------------------------------------------
# Folder whose JSONL records lose the listed keys.
DROP_KEYS_BY_FOLDER = {"CodeTransOcean_dataset": ("id",)}
CORPUS_NAME = "final_dataset_v2.jsonl"

# --- experiments --------------------------------------------------------------
MODEL_TYPES = ("Baseline", "Proposed")
SEEDS = (42, 1337, 2024, 777, 999)
NUM_FOLDS = 2
TRAIN_SHARE = 0.9
HOLDOUT_SHARE = 0.2
TEST_SHARE_OF_HOLDOUT = 0.5
SINGLE_RUN_SEED = 42
MAX_SEQ_LENGTH = 8192
INFERENCE_BATCH_SIZE = 4

# --- chat ---------------------------------------------------------------------
CHAT_START = "<|im_start|>"
CHAT_END = "<|im_end|>"
RESPONSE_MARKER = "<|im_start|>assistant\n"
IGNORE_INDEX = -100

BASELINE_PREFIX = "Convert this C code to Rust:\n\n"

SYSTEM_PROMPT = """Convert the provided C program into safe, highly idiomatic stable Rust.

Rules for Translation:
1. Pure Safe Rust: Prefer 100% safe code. Use `unsafe` only if it is fundamentally impossible to achieve the behavior otherwise.
2. Native Types: Use standard Rust types (`i32`, `usize`, `str`, `String`, etc.). Strictly avoid FFI types (`c_int`, `c_char`, `c_void`, `*mut T`).
3. Idiomatic Memory & Ownership: Translate C-style manual memory management, pointer arithmetic, and raw arrays into Rust's ownership model (e.g., `Vec<T>`, `Box<T>`, slices, and iterators).
4. Error Handling: Refactor C-style error codes (e.g., returning -1 or NULL) into idiomatic `Result<T, E>` or `Option<T>` patterns.
5. Standard Library Only: Do not use any external crates unless they are commonly used. Rely almost entirely on `std`.
6. Zero Comments: Do not include any code comments in your output.
7. Inline Assembly: Replace __asm__ with safe equivalents or core::arch::asm!.
8. Identifier Preservation: Preserve original names but adjust to snake_case/PascalCase standards.

Output Format:
Respond STRICTLY with a single markdown code block tagged `rust`. Do not provide any conversational filler, explanations, or text before or after the code block. Your entire response must begin exactly with ```rust and end exactly with ```."""
