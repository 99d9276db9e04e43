"""Fixed values.

Everything in this module is a value that results must agree on: word lists,
code tables, text patterns and message formats of the trace and document
formats.  It is data, kept together and in natural order; the logic that uses it
lives elsewhere.  Patterns use Java regular-expression syntax; the ``(?U)`` flag
gives ``\\w \\d \\s \\b`` their Unicode meaning and ``(?iu)`` ignores case.
"""

# --- trace files -------------------------------------------------------------

TRACE_EXTENSIONS = (".txt", ".log", ".trc", ".trc68", ".dat")
TRACE_INFIX = ".trc"

# --- trace line patterns -----------------------------------------------------

HAS_SESSION = r"(?U)^\s*[^|\s][^|]*\s[^|\s]+\|"
MTI_LABEL = r"M\.?\s*T\.?\s*I\.?"
MTI = rf"(?iuU){MTI_LABEL}\s*:+\s*\[?(\d{{3,4}})\]?"
MTI_START = rf"(?iuU)-\s*{MTI_LABEL}\s*:+\s*\[?(\d{{3,4}})\]?"
MTI_1110 = rf"(?iuU){MTI_LABEL}\s*:+\s*\[?1110\]?"

TRANSACTION_ID = r"(?U)TRANSACTION_IDENTIFIER\}\s*\d+\s+(\S+)"
STAN = r"(?U)INTERNAL STAN\}\s*\d+\s+(\S+)"
PAN = r"(?U)PAN\}\s*\d+\s+(\S+)"
CARD_NUMBER = r"(?U)CARD_NUMBER\}\s*\d+\s+(\S+)"

FIELD = r"(?iuU)-\s*(?:FLD|DE)\s*\((\d+)\)\s*:?\s*\((\d+|LLLVAR|LLVAR)\)\s*:?\s*\[([^\]]*)\]"
FIELD_PREFIX = r"(?iuU)(FLD|DE)\s*\("
DUMP_011 = r"(?iuU)(?:FLD|DE)\s*\(011\)\s*:?[^:]*:\s*\[?(\d+)\]?"
DUMP_037 = r"(?iuU)(?:FLD|DE)\s*\(037\).*?\[([^\]]+)\]"
DUMP_039 = r"(?iuU)(?:FLD|DE)\s*\(039\).*?\[([^\]]+)\]"

TO_HSM = r"(?iuU)TO\s+HSM\s*:\s*(?:Len=\[\d+\]-->\s*Data=)?\s*(.*?)$"
FROM_HSM = r"(?iuU)FROM\s+HSM\s*:\s*<--(.*?)$"
HSM_RESULT = r"(?iuU)(?:HsmResultCode\s*=\s*|HSM_RESULT_CODE\s*\.*\s*\)\s*:\s*\[?)(\w+)"
HSM_OK = ("0", "00", "000")

HEARTBEAT_FIELD = "FLD (070)"
HEARTBEAT_VALUE = "[301]"
APPROVED_CODES = ("00", "000")

TRACE_HINT = r"(?iuU)MTI|M\.T\.I|FLD\s*\(|DE\s*\d+|\bPAN\b|\bSTAN\b|\bRRN\b|0200|0210|0100|0110|1100|1110"
TRACE_HINT_LINES = 200

# --- function results --------------------------------------------------------

FAIL_TOKEN = (
    r"(?:NOK\s*\(\s*-\d+\s*\)"
    r"|NOK"
    r"|\(\s*NOK\s*\)"
    r"|\(\s*-\d+\s*\)"
    r"|!=\s*OK"
    r"|!=\s*0"
    r"|ERROR"
    r"|(?:r[ée]sultat|result(?:at)?|returned|return(?:ed|s)?|code)\s*[=:]?\s*-+\s*[1-9]\d*"
    r"|=\s*-+\s*[1-9]\d*)"
)
CALL_GAP = r"(?:\s*\(\s*\))?\s*(?::\s*)?"
GENERIC_FAILURE = rf"(?iuU)\b([A-Za-z][A-Za-z0-9_]{{2,}})\b{CALL_GAP}({FAIL_TOKEN})"
SIGNED_CODE = r"(?U)(?<![0-9])-+\s*([1-9]\d*)\b"
NEAR_WINDOW = 80
SUCCESS_MARKERS = ("End", "Exit", "Return", "END", "EXIT")
NOT_FUNCTIONS = ("END", "START", "FLD", "MTI", "PAN", "STAN", "RRN", "FROM", "TO", "HSM", "LEVEL")

# --- messages ----------------------------------------------------------------

MTI_UNKNOWN = "Message ISO 8583 Non Spécifié"
FIELD_UNKNOWN = "Champ ISO 8583"

MSG_MTI = "Message Réseau Entrant (Incoming Request) MTI [%s] (%s) détecté."
MSG_RRN = "Champ [FLD 037] (Retrieval Reference Number / RRN) détecté : %s."
MSG_RESPONSE = "Champ [FLD 039] (Response Code) détecté : %s (%s)."
MSG_FIELD = "Champ [%s %s] (%s - %s) : [%s]"
MSG_TO_HSM = "Échange HSM (TO HSM) : Commande transmise au HSM -> %s"
MSG_FROM_HSM = "Échange HSM (FROM HSM) : Réponse reçue du HSM -> %s"
MSG_HSM_RESULT = "Code Résultat HSM (HsmResultCode) : %s"
MSG_HSM_ALERT = "Erreur HSM détectée : Code d'erreur HSM %s."
MSG_ISO_TO_TLV = "Conversion des données : Format réseau ISO 8583 vers format interne TLV."
MSG_VALIDATE_TLV = "Contrôle structurel : Validation du format des données TLV."
MSG_LOAD_ISSUER = "Traitement : Chargement des paramètres de la banque émettrice."
MSG_FAILED = "%s() a échoué (résultat : %s)."
MSG_FAILED_UNDOCUMENTED = "%s() a échoué (résultat : %s) — fonction non documentée dans %s."
MSG_SUCCEEDED = "Fonction %s() exécutée avec succès (résultat : %s)."
MSG_ALERT = "ALERTE : %s"
MSG_FORMAT_ALERT = "ALERTE FORMAT : %s"
MSG_RESPONSE_SENT = "Message Réseau Sortant (Outgoing Response) généré avec le Code Réponse [FLD 039] = %s."
MSG_NO_RESPONSE = (
    "Aucun message de réponse (MTI 1110) retrouvé pour ce STAN dans le fichier — "
    "transaction probablement mise en attente (Store-and-Forward) ou trace incomplète."
)
LABEL_APPROVED = "Approuvée"
LABEL_DECLINED = "Déclinée (Code: %s)"
LABEL_UNKNOWN = "Inconnue"
NONE_FEMININE = "Aucune"
NOT_AVAILABLE = "N/A"
EMPTY_VALUE = "(vide)"

# --- ISO 8583 message types and fields ---------------------------------------

MESSAGE_TYPES = """
0100|Authorization Request
0110|Authorization Request Response
0120|Authorization Advice
0130|Authorization Advice Response
0200|Financial Request
0210|Financial Request Response
0220|Financial Advice
0230|Financial Advice Response
0400|Reversal Request
0410|Reversal Request Response
0420|Reversal Advice
0430|Reversal Advice Response
0800|Network Management Request (Heartbeat/Echo)
0810|Network Management Response (Heartbeat/Echo Response)
1100|Authorization Request (BASE I / Visa)
1110|Authorization Response (BASE I / Visa)
"""

ISO_FIELDS = """
001|Bitmap|Secondary Bitmap Indicator
002|PAN|Primary Account Number (Numéro de carte)
003|Processing Code|Code d'opération (retrait, paiement, etc.)
004|Amount, Transaction|Montant de la transaction
006|Amount, Cardholder Billing|Montant facturé au porteur
007|Transmission Date & Time|Date et heure de transmission (MMDDhhmmss)
009|Conversion Rate, Settlement|Taux de conversion, règlement interbancaire (8 N)
010|Conversion Rate, Cardholder Billing|Taux de conversion, facturation titulaire (8 N)
011|STAN|System Trace Audit Number (Numéro séquentiel)
012|Time, Local Transaction|Heure locale de la transaction (hhmmss)
013|Date, Local Transaction|Date locale de la transaction (MMDD)
014|Expiration Date|Date d'expiration de la carte (YYMM)
018|Merchant Category Code|Code MCC commerçant
019|Acquiring Institution Country Code|Code pays de l'acquéreur
022|POS Entry Mode|Mode de saisie au point de vente (puce, bande, sans contact)
023|Card Sequence Number|Numéro de séquence de la carte
025|POS Condition Code|Conditions du point de vente
032|Acquiring Institution ID Code|Identifiant de la banque acquéreuse
035|Track 2 Data|Piste 2 de la carte
037|RRN|Retrieval Reference Number (Référence unique transaction)
038|Authorization Code|Code d'autorisation accordé par l'émetteur
039|Response Code|Code de réponse ISO 8583 (00=OK, etc.)
041|Terminal ID (TID)|Identifiant du terminal commerçant/GAB
042|Merchant ID (MID)|Identifiant du commerçant
043|Card Acceptor Name/Location|Nom et localisation du commerçant
048|Private Additional Data|Données privées complémentaires
049|Currency Code, Transaction|Code devise de la transaction
052|PIN Data|Bloc PIN chiffré
053|Security Related Control Info|Informations de contrôle de sécurité (CVV/ARQC)
055|EMV / ICC Data|Données Puce EMV / TLV
070|Network Management Code|Code de gestion de réseau (301 = Heartbeat)
090|Original Data Elements|Données d'origine de la transaction (en cas d'annulation)
102|Account Identification 1|Identifiant compte source
103|Account Identification 2|Identifiant compte destination
120|Private Data (Network)|Données privées spécifiques au réseau
127|Private Data (Internal)|Données privées internes
"""

# Network specification of fields: number|name|length|type|encoding.
NETWORK_FIELDS = """
1|Bitmap|8|B|Binary
2|Primary Account Number (PAN)|19|N|BCD
3|Processing Code|6|N|BCD
4|Amount, Transaction|12|N|BCD
5|Amount, Settlement|12|N|BCD
6|Amount, Cardholder Billing|12|N|BCD
7|Transmission Date & Time|10|N|BCD
9|Conversion Rate, Settlement|8|N|BCD
10|Conversion Rate, Cardholder Billing|8|N|BCD
11|System Trace Audit Number (STAN)|6|N|BCD
12|Time, Local Transaction|6|N|BCD
13|Date, Local Transaction|4|N|BCD
14|Date, Expiration|4|N|BCD
15|Date, Settlement|4|N|BCD
16|Date, Conversion|4|N|BCD
17|Date, Capture|4|N|BCD
18|Merchant Type (MCC)|4|N|BCD
19|Acquiring Institution Country Code|3|N|BCD
20|PAN Country Code|3|N|BCD
21|Forwarding Institution Country Code|3|N|BCD
22|Point of Service Entry Mode|3|N|BCD
23|Card Sequence Number|3|N|BCD
24|Function Code (NII)|3|N|BCD
25|Point of Service Condition Code|2|N|BCD
26|Point of Service PIN Capture Code|2|N|BCD
28|Amount, Transaction Fee|8|N|BCD
29|Amount, Settlement Fee|8|N|BCD
30|Amount, Transaction Processing Fee|8|N|BCD
31|Amount, Settlement Processing Fee|8|N|BCD
32|Acquiring Institution Identification Code|11|N|BCD
33|Forwarding Institution Identification Code|11|N|BCD
35|Track 2 Data|37|N|BCD
37|Retrieval Reference Number (RRN)|12|AN|EBCDIC
38|Authorization Identification Response|6|AN|EBCDIC
39|Response Code|2|AN|EBCDIC
40|Service Restriction Code|3|N|BCD
41|Card Acceptor Terminal Identification|8|ANS|EBCDIC
42|Card Acceptor Identification Code|15|ANS|EBCDIC
43|Card Acceptor Name/Location|40|ANS|EBCDIC
49|Currency Code, Transaction|3|N|BCD
50|Currency Code, Settlement|3|N|BCD
51|Currency Code, Cardholder Billing|3|N|BCD
52|Personal Identification Number (PIN) Data|8|B|Binary
55|Integrated Circuit Card System Related Data|255|ANS|Binary
70|Network Management Information Code|3|N|BCD
90|Original Data Elements|42|N|BCD
"""
NETWORK_SOURCE = "Spécification réseau BASE I"

# Standard dictionary: number|name|attributes.
STANDARD_FIELDS = """
1|Bitmap|16 AN
2|Primary Account Number (PAN)|19 N
3|Processing Code|6 N
4|Amount, Transaction|12 N
5|Amount, Settlement|12 N
6|Amount, Cardholder Billing|12 N
7|Transmission Date & Time|10 N
8|Amount, Cardholder Billing Fee|8 N
9|Conversion Rate, Settlement|8 N
10|Conversion Rate, Cardholder Billing|8 N
11|System Trace Audit Number (STAN)|6 N
12|Time, Local Transaction|6 N
13|Date, Local Transaction|4 N
14|Expiration Date|4 N
15|Date, Settlement|4 N
16|Date, Conversion|4 N
17|Date, Capture|4 N
18|Merchant Category Code|4 N
19|Acquiring Institution Country Code|3 N
20|PAN Country Code|3 N
21|Forwarding Institution Country Code|3 N
22|Point of Service Entry Mode|3 N
23|Card Sequence Number|3 N
24|Function Code (NII)|3 N
25|Point of Service Condition Code|2 N
26|Point of Service Capture Code|2 N
27|Authorizing Identification Response Length|1 N
28|Amount, Transaction Fee|9 N
29|Amount, Settlement Fee|9 N
30|Amount, Transaction Processing Fee|9 N
31|Amount, Settlement Processing Fee|9 N
32|Acquiring Institution Identification Code|11 N
33|Forwarding Institution Identification Code|11 N
34|Primary Account Number, Extended|28 AN
35|Track 2 Data|37 AN
36|Track 3 Data|104 AN
37|Retrieval Reference Number (RRN)|12 AN
38|Authorization Identification Response (Auth Code)|6 AN
39|Response Code|2 AN
40|Service Restriction Code|3 N
41|Card Acceptor Terminal Identification (TID)|8 AN
42|Card Acceptor Identification Code (MID)|15 AN
43|Card Acceptor Name/Location|40 AN
44|Additional Response Data|25 AN
45|Track 1 Data|76 AN
46|Additional Data - ISO|999 AN
47|Additional Data - National|999 AN
48|Additional Data - Private|999 AN
49|Currency Code, Transaction|3 N
50|Currency Code, Settlement|3 N
51|Currency Code, Cardholder Billing|3 N
52|PIN Data|16 AN
53|Security Related Control Information|16 AN
54|Additional Amounts|120 AN
55|Integrated Circuit Card System Related Data|999 AN
56|Original Data Elements|35 N
57|Authorization Life Cycle Code|3 N
58|Authorizing Agent Institution Id Code|11 AN
59|Echo Data|255 AN
60|Private Data|999 AN
61|Private Data|999 AN
62|Private Data|999 AN
63|Private Data|999 AN
64|Message Authentication Code|8 AN
70|Network Management Code|3 N
90|Original Data Elements|42 N
102|Account Identification 1|28 AN
103|Account Identification 2|28 AN
120|Private Data (Network)|999 AN
127|Private Data (Internal)|999 AN
"""
STANDARD_SOURCE = "Standard ISO 8583"
SESSION_SOURCE = "document de session"
GLOBAL_SOURCE = "global database"

# --- field conformance -------------------------------------------------------

EXPECTED_TYPE = r"(?U)(\d+)\s+([ANSB]{1,3})\b"
NOT_STRICTLY_NUMERIC = "52"
TYPE_LABELS = """
N|N (numérique)
A|A (alphabétique)
AN|AN (alphanumérique)
ANS|ANS (alphanumérique + spéciaux)
NS|NS (numérique + spéciaux)
"""
REASON_MISSING = "Champ absent de la trace"
REASON_NOT_NUMERIC = "contient des lettres/symboles non conformes (attendu numérique)"
REASON_NOT_ALPHABETIC = "contient des chiffres/symboles non conformes (attendu alphabétique)"
REASON_TOO_LONG = "longueur (%d) dépasse le maximum (%d)"
MSG_VIOLATION = "Champ %s (FLD %s) : type attendu %s (%s), valeur observée '%s' — %s"

# --- field tables in page text -----------------------------------------------

FIELD_HEADER = r"(?iuU)Field\s+(\d{1,3})\s*[—\-–]+\s*(.+)"
FIELD_ROW = (
    r"(?U)^\s*(\d{1,3})\s{2,}(.+?)\s{2,}(?:[FVA]\s{2,})?(?:\d+\s{2,})?(\d+)\s{2,}"
    r"([A-Z]+(?:\s*,\s*[A-Z0-9 ]+)?).*$"
)
FIELD_ROW_SHORT = r"(?U)^\s*(\d{1,3})\s{2,}(.+?)\s{2,}(\d+)\s{2,}([A-Z]{1,4})\b"
FIELD_TYPES = ("ANS", "AN", "NS", "AS", "N", "A", "B", "Z")
FIELD_NUMBERS = (1, 128)

# --- security-module commands and results ------------------------------------

COMMAND_RESPONSES = """
EC ED
CA CB
CC CD
CW CX
DG DH
EE EF
EG EH
FA FB
FC FD
FE FF
FG FH
GA GB
GC GD
IA IB
KA KB
KC KD
KE KF
KG KH
MA MB
MC MD
ME MF
MG MH
MI MJ
MY MZ
NC ND
NG NH
OA OB
OC OD
OE OF
PA PB
PC PD
PE PF
RA RB
RC RD
"""
DEFAULT_COMMAND = ("EC", "ED")
NUMBER_ONLY_RESPONSES = ("ED", "CX", "ND", "MB")

HSM_CODE = (
    r"(?iuU)(?:"
    r"Code d'erreur HSM\s+([A-Za-z0-9]+)|"
    r"HsmResultCode\s*[:=]?\s*\[?([A-Za-z0-9]+)|"
    r"Erreur HSM[^\dA-Za-z]*([A-Za-z]{2}\d{2}|\d{2,3}|[A-Za-z]{2})|"
    r"\b(?:FROM\s+HSM|TO\s+HSM)[^\n]*?\b([A-Z]{2}\d{0,2})\b|"
    r"\b([A-Z]{2}\d{2})\b|"
    r"\bED\s*[_\-]?\s*(\d{2})\b"
    r")"
)
HSM_TOKEN_TRIM = ".:[]()\"'"
HSM_CODE_SHAPE = r"(?iuU)\b[A-Z]{2}\d{2}\b|\bED\b|\bEC\b"
HSM_REPORT_CODES = (
    r"(?iu)Code d'erreur HSM\s+([A-Za-z0-9]+)",
    r"(?iu)HsmResultCode\s*[:=]?\s*\[?([A-Za-z0-9]+)",
    r"(?iu)Erreur HSM[^\n]*?\b([A-Za-z]{2}\d{2}|\d{2,3}|[A-Za-z]{2})\b",
    r"\b([A-Z]{2}\d{2})\b",
    r"(?iu)\bED\s*[_\-]?\s*(\d{2})\b",
)
HSM_REPORT_SHAPE = r"\b[A-Z]{2}\d{2}\b"

# Codes the dictionary knows when no file is given; their texts come from a file.
HSM_ERROR_CODES = ("05", "15", "99", "ED", "ED05", "EC")
HSM_ERROR_SOURCE = "dictionnaire HSM"

# --- excerpts ----------------------------------------------------------------

PAGE_ARTIFACTS = (
    r"(?U)^--- Page \d+ ---$",
    r"^--- Début page suivante.*$",
    r"^\[CORRESPONDANCE RAG.*\]$",
    r"^\[Le code de réponse.*\]$",
    r"payShield 10K Core Host Commands",
    r"Thales Group.*Page|Page.*Thales Group",
    r"All Rights Reserved",
)
SCORE_OTHER_CODE = -100.0
SCORE_CODE_TOKEN = 20.0
SCORE_ERROR_TABLE = 15.0
SCORE_NO_ERROR = 10.0
SCORE_CODE_ROW = 15.0
SCORE_OTHER_CHAPTER = -30.0
SCORE_CONTENTS_PAGE = -5.0
CODE_ROW = r"(?U)'\d{2}'\s*:"
EXCERPT_MIN_SCORE = -20.0

MSG_CODE_PAIR = (
    "[CORRESPONDANCE RAG : Code Réponse '%2$s' <-> Code Commande Source '%1$s']\n"
    "[Le code de réponse '%2$s' est généré par la commande '%1$s']\n"
)

# --- chunks ------------------------------------------------------------------

CHUNK_SIZE = 2500
CHUNK_OVERLAP = 300
CHUNK_VERSION = "v2"
SEPARATORS = ("\n\n", "\n", " ", "")
PAGE_HEAD = "--- Page %s ---\n"
PAGE_BRIDGE = "\n\n--- Début page suivante (contexte) ---\n"
COMMAND_PAIR = r"(?iuU)\b([A-Z0-9]{2})\s*(?:\/|\s+and\s+|\s*\(\s*)\s*([A-Z0-9]{2})\s*\)?"
RESPONSE_VALUE = r"(?iuU)Response Code\s+2\s*A\s+Value\s*'(\w{2})'"
ERROR_TABLE_WORDS = ("parity error", "pin block format has been disabled", "response code", "error code")
PARITY_ERROR = "pvk parity error"
MAX_PAGES = 1000
MIN_TEXT_RATIO = 0.5
BATCH_ITEMS = 40
BATCH_TOKENS = 12000
PURGE_DAYS = 7
LIBRARY_ROWS = 50

# --- questions ---------------------------------------------------------------

CODE_PHRASES = (
    r"(?iuU)(?:code\s+de\s+réponse|code\s+de\s+reponse|code\s+reponse|code\s+réponse)\s*(?:est|=|:\s*)?\s*['\"]?([A-Za-z]{2})\b['\"]?",
    r"(?iuU)\bréponse\s+(?:est\s+|:\s*)?['\"]?([A-Za-z]{2})\b['\"]?",
    r"(?iuU)\breponse\s+(?:est\s+|:\s*)?['\"]?([A-Za-z]{2})\b['\"]?",
    r"(?iuU)commande\s+(?:dont\s+la\s+réponse|dont\s+le\s+code\s+de\s+réponse|source\s+(?:du|de)\s+(?:code|la réponse))\s+(?:est\s+)?['\"]?([A-Za-z]{2})\b['\"]?",
    r"(?iuU)(?:code\s+)?(?:commande|command|cmd)\s*(?:est|=|:\s*)?\s*['\"]?([A-Za-z]{2})\b['\"]?",
    r"(?iuU)\bcode\s*[:\s]?['\"]([A-Za-z]{2})['\"]",
    r"(?iuU)['\"]([A-Za-z]{2})['\"]",
    r"(?iuU)\b([A-Za-z]{2})\b\s*(?:est\s+le\s+code|est\s+la\s+commande|est\s+le\s+code\s+de\s+réponse|est\s+la\s+réponse)\b",
)
CODE_WORD = r"(?U)\b[A-Z]{2}\b"
CODE_STOPWORDS = (
    "ET OU DE LE LA DU AU UN EN SI NO CE CI SA SES SON EST PAS QUE QUI PAR "
    "SUR DES NE ON IL SE MA TA TE ME"
)
TERM_WORD = r"(?U)\b[A-Z0-9]{2,6}\b"
TERM_STOPWORDS = (
    CODE_STOPWORDS + " AVEC DANS POUR CETTE QUEL QUELLE SONT LES PLUS COMMENT FIELD TRANSACTION "
    "STAN PAN RRN MTI CODE RESPONSE QU"
)
COUNT_STOPWORDS = (
    "COMBIEN NOMBRE TRACE ERREUR AVEC DANS POUR CETTE QUEL SONT LES DES ET OU DE LE LA DU AU UN EN SI NO "
    "CE CI SA EST PAS QUE QUI PAR SUR NE ON IL"
)
FIELD_MENTION = r"(?iuU)(?:field|champ|fld)\s*0*(\d+)"
BROAD_WORDS = (
    "résume", "resume", "summarize", "summary", "overview", "combien de", "toutes les", "tous les", "sommaire",
    "global", "structure", "chapitres", "sections", "présente", "presente",
)
BROAD_K = 16
NARROW_K = 8
MERGED_CHUNKS = 10
DEFAULT_SEARCH = "spécification"

# --- function specification scores -------------------------------------------

SPEC_NAME_POINTS = 10
SPEC_DESCRIPTION_POINTS = 3
SPEC_EXCEPTION_POINTS = 2
SPEC_WHOLE_NAME_POINTS = 20
SPEC_MIN_SCORE = 8

# --- context and payload -----------------------------------------------------

CONTEXT_CHARS = 80000
BLOCK_SEPARATOR_CHARS = 4
HEADER_ALLOWANCE = 200
ALERT_WORDS = ("alerte", "alertes:", "erreur", "échec", "nok", "-1", "-2")
RAW_TEXT_CAP = 15000
SAFE_SHARE = 0.8
CHARS_PER_TOKEN = 4
MIN_CUT = 200
CUT_MARGIN = 300

# --- report ------------------------------------------------------------------

REPORT_ROWS = 20
STEP_ERROR = r"(?iuU)\b(nok|échec|echec|error|failed|refuse)\b|-\s*[1-9]\d*|r[ée]sultat\s*-"
STEP_FUNCTION = (
    r"(?iuU)(?:\b([A-Za-z][A-Za-z0-9_]{2,})\s*\(\s*\)"
    r"|(?:fonction|ex[ée]cution de|appel(?:\s+de)?)\s+([A-Za-z][A-Za-z0-9_]{2,})"
    r"|\b([A-Za-z][A-Za-z0-9_]{2,})\s*:\s*r[ée]sultat)"
)
STEP_SUCCESS = r"(?iu)\b(ok|succès|succes|approved|approuv|réussi|reussi)\b"
MSG_FUNCTION_FAILED = "%s() a échoué."
MSG_HINT = "Échec détecté sur : %s."

# --- usage -------------------------------------------------------------------

DAILY_REQUESTS = 1000
TOKEN_BUDGET = 1000000
TITLE_WORDS = 8
TITLE_CHARS = 80
