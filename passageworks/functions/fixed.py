"""Results match the reference only with exactly these.

All of them are defaults of operator arguments and can be replaced there.
"""

# Topic map: the first topic with a matching keyword wins, in this order.
TOPICS = {
    "Jegy – Belépési problémák": ["belépni", "jelszó", "fiók", "login", "bejelentkezés"],
    "Jegy – Számlázás": ["számla", "számlázás", "díj", "billing", "invoice"],
    "Jegy – Teljesítmény": ["lassú", "betöltés", "teljesítmény", "performance"],
    "Ügyfél": ["ügyfél", "customer"],
    "Support": ["support", "ügynök", "agent"],
}
DEFAULT_LABEL = "[Általános]"

# Ticket document: field captions, in document order.
TICKET_CAPTIONS = {
    "id": "Jegy ID: ",
    "title": "\nCím: ",
    "user": "\nÜgyfél: ",
    "status": "\nStátusz: ",
    "priority": ", Prioritás: ",
    "category": ", Kategória: ",
    "created": "\nLétrehozva: ",
    "closed": ", Lezárva: ",
    "conversation": "\n\nBeszélgetés:\n",
}
NULL_TEXT = "None"

# Context layout.
CONTEXT_HEADER = "KONTEKSTUS:\n"
CHUNK_SEPARATOR = "\n\n---\n\n"
BLOCK_SEPARATOR = "\n\n====================\n\n"
BLOCK_CAPTION = "[TICKET {}]\n"
QUESTION_CAPTION = "KÉRDÉS: "
NO_CONTEXT_REPLY = "Nem találtam releváns kontextust az adatbázisban."

# Reply layout.
ANSWER_CAPTION = "Válasz:"
QUOTE_CAPTION = "Idézet:"
DECLINED_REPLY = "Nem szerepel a kontextusban."

# Chat request.
CHAT_MODEL = "llama3.2:3b"
STOP_SEQUENCES = ["\n\nKONTEKSTUS", "\nKÉRDÉS:", "Szabályok:", "Feladat:"]
MAX_REPLY_TOKENS = 256

# Sizes.
EMBEDDING_DIM = 384
INDEX_LISTS = 100
MAX_TOKENS = 300
TOP_K = 12
CANDIDATE_K = 80
TOP_GROUPS = 2
MODEL_MAX_CONTEXT = 4096
RESERVE_FOR_ANSWER = 350
EMBED_BATCH = 256
INSERT_PAGE = 500
QUIT_WORDS = ["exit", "quit"]
SOURCE_TABLE = "tickets"

# Own wording: the instruction text does not influence any computed result.
SYSTEM_PROMPT = (
    "Csak a megadott kontextusra támaszkodva, magyarul felelj.\n"
    "Ha a kontextus nem tartalmazza a választ, ezt add vissza: "
    f"{DECLINED_REPLY}\n"
    "Két-öt mondatban felelj, és idézz egyszer szó szerint a kontextusból.\n"
    f"Az első rész kezdete {ANSWER_CAPTION} a másodiké {QUOTE_CAPTION} "
    "és az idézet idézőjelek között álljon."
)
