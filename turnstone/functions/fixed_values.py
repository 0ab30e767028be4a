"""Word lists, patterns, maps and thresholds whose exact content decides results.

They are plain data, kept together so that a reader can compare and a caller can override them.
Patterns are written for Java regex; ``UNICODE_FLAGS`` is prepended where they are used so that
``\\b`` and case folding cover accented letters on every JDK.
"""

UNICODE_FLAGS = "(?iU)"

# --- human prompts ---------------------------------------------------------------------------
SYNTHETIC_PREFIXES = [
    "<system-reminder>", "<local-command-", "<command-name>", "<command-message>",
    "<command-args>", "Caveat:", "<user-prompt-submit-hook>",
]

# --- task boundaries -------------------------------------------------------------------------
CORRECTIVE_OPENERS = [
    "non", "non,", "en fait", "plutôt", "au lieu", "corrige", "corriges", "reprends",
    "refais", "reformule", "ça ne marche", "ca ne marche", "ça marche pas", "toujours pas",
    "il manque", "tu as oublié", "pas tout à fait", "presque", "essaie", "essaye",
    "peux-tu plutôt", "j'ai une erreur", "erreur", "ça plante", "ca plante", "revois",
]
CONTINUATION_OPENERS = [
    "continue", "poursuis", "vas-y", "ok", "oui", "d'accord", "parfait", "super",
    "et maintenant", "ensuite", "maintenant", "aussi", "et ", "pareil",
]
REFERENTIAL_PATTERN = (
    r"\b(ça|ca|cela|celui|celle|ceux|le même|la même|ce|cette|cet|il|elle|ils|elles|y|en)\b"
)
SILENCE_MINUTES = 25
UNFINISHED_MINUTES = 5
SHORT_PROMPT_CHARS = 160
IDLE_GAP_MINUTES = 15
TITLE_MIN_CUT = 12
TITLE_MAX_CHARS = 80

# --- task signals ----------------------------------------------------------------------------
VERIFICATION_PATTERN = (
    r"\b(dotnet\s+test|npm\s+(run\s+)?test|npm\s+run\s+build|ng\s+test|ng\s+build|pytest|jest|vitest"
    r"|cargo\s+test|go\s+test|dotnet\s+build|eslint|ruff|mypy)\b"
)
ACCEPTANCE_PATTERN = (
    r"\b(doit|devra|critère|attendu|il faut que|jusqu'à ce que|test|tests? (vert|passe)|vérifie|valide"
    r"|sans (casser|régression)|renvoie|retourne)\b"
)
CONTEXT_WINDOW = 200_000
RETRY_HORIZON = 3

# --- prompt rubric: key, essential, pattern --------------------------------------------------
# RUBRIC_LITERALS: a text that matches the pattern holds one of these (lower case); they are looked for first.
RUBRIC = [
    ("objectif", True,
     r"\b(ajoute|crée|créer|corrige|corriger|implémente|implémenter|écris|écrire|extrais|extraire|remplace"
     r"|remplacer|supprime|refactor|migre|migrer|documente|documenter|teste|tester|optimise|optimiser"
     r"|renomme|déplace)\b"),
    ("perimetre", True,
     r"(\b[\w\-/\.]+\.(cs|ts|js|py|json|html|scss|css|sql|md|yml|yaml|razor|xaml)\b)"
     r"|\b(dans le (module|dossier|service|projet|fichier)|uniquement dans|sans toucher|ne touche pas|hors de)\b"),
    ("acceptation", True,
     r"\b(doit|devra|il faut que|jusqu'à ce que|critère|attendu|test[s]? (vert|passe|passent)"
     r"|quand .* (marche|fonctionne)|vérifie que|valide que|renvoie|retourne|affiche"
     r"|sans (casser|régression))\b"),
    ("contraintes", False,
     r"\b(sans (casser|changer|ajouter|modifier)|garde|garder|conserve|conserver|compatib"
     r"|ne pas (utiliser|ajouter)|reste en|en gardant|même (style|convention)|pas de nouvelle dépendance"
     r"|performance)\b"),
    ("sortie", False,
     r"\b(renvoie|retourne|donne[- ]moi|écris dans|dans un fichier|au format|en (json|markdown|tableau|liste)"
     r"|un patch|explique|résume)\b"),
    ("contexte", True,
     r"\b(parce que|car|le but est|on avait|historiquement|la contrainte est|attention[,:]|à savoir|contexte)\b"),
    ("autonomie", True,
     r"\b(va jusqu'au bout|jusqu'à ce que .* passe|propose|demande[- ]moi|ne (commit|pousse)"
     r"|avant d'appliquer|sans me demander|autonom)\b"),
]

RUBRIC_LITERALS = {
    "objectif": ["ajoute", "crée", "corrige", "implémente", "écri", "extrai", "remplace", "supprime", "refactor", "migre",
                 "documente", "teste", "optimise", "renomme", "déplace"],
    "perimetre": [".cs", ".ts", ".js", ".py", ".html", ".scss", ".sql", ".md", ".y", ".razor", ".xaml", "dans le ", "uniquement dans",
                  "sans toucher", "ne touche pas", "hors de"],
    "acceptation": ["doit", "devra", "il faut que", "jusqu'à ce que", "critère", "attendu", "test", "quand ", "vérifie que", "valide que",
                    "renvoie", "retourne", "affiche", "sans "],
    "contraintes": ["sans ", "garde", "conserve", "compatib", "ne pas ", "reste en", "en gardant", "même ", "pas de nouvelle dépendance",
                    "performance"],
    "sortie": ["renvoie", "retourne", "donne", "écris dans", "dans un fichier", "au format", "en ", "un patch", "explique", "résume"],
    "contexte": ["parce que", "car", "le but est", "on avait", "historiquement", "la contrainte est", "attention", "à savoir", "contexte"],
    "autonomie": ["va jusqu'au bout", "jusqu'à ce que", "propose", "demande", "ne ", "avant d'appliquer", "sans me demander", "autonom"],
}
FILE_LITERALS = [".cs", ".ts", ".js", ".py", ".html", ".scss", ".sql", ".md", ".y", ".razor", ".xaml"]

# --- rewrite checks --------------------------------------------------------------------------
FILE_NAME_PATTERN = r"\b[\w\-/\.]+\.(?:cs|ts|js|py|json|html|scss|css|sql|md|yml|yaml|razor|xaml)\b"
IDENTIFIER_PATTERN = r"\b[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+\b"
NUMBER_PATTERN = r"\b\d+\b"
BRACKETED_PATTERN = r"\[[^\]]*\]"
FRENCH_WORDS = [
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "dans", "pour", "que", "qui", "ne", "pas", "sur",
    "avec", "est", "sont", "aux", "cette", "ses", "plus", "tout", "sans", "par", "elle",
]
ENGLISH_WORDS = [
    "the", "and", "with", "must", "should", "this", "that", "your", "please", "following", "make", "sure", "will",
    "have", "been", "from", "when", "which",
]
ADDRESS_WORDS = ["vous", "votre", "vos", "tu", "ton", "ta", "tes", "toi"]
COMMENT_OPENERS = [
    "voici", "voilà", "ce prompt", "le prompt", "je propose", "je te propose",
    "il s'agit", "cette réécriture", "en résumé", "note :", "réécriture :",
]
EURO_PATTERN = r"\d+\s?(?:€|euros?)"

# --- label scales: scale, label, score (NULL = undecided) ------------------------------------
LABEL_SCALES = [
    ("conformite", "conforme", 1.0), ("conformite", "non_conforme", 0.0), ("conformite", "indeterminable", None),
    ("promesse", "tenue", 1.0), ("promesse", "rompue", 0.0), ("promesse", "indeterminable", None),
    ("accord", "accord", 1.0), ("accord", "desaccord", 0.0), ("accord", "douteux", 0.0),
    ("accord", "indeterminable", None),
]
UNDECIDED = "indeterminable"

# --- live hooks: URL segment -> canonical name ------------------------------------------------
HOOK_ROUTES = {
    "session-start": "SessionStart", "session-end": "SessionEnd", "user-prompt": "UserPromptSubmit",
    "stop": "Stop", "stop-failure": "StopFailure", "post-tool": "PostToolUse",
    "post-tool-fail": "PostToolUseFailure", "post-tool-batch": "PostToolBatch", "pre-compact": "PreCompact",
    "post-compact": "PostCompact", "subagent-start": "SubagentStart", "subagent-stop": "SubagentStop",
    "task-created": "TaskCreated", "task-completed": "TaskCompleted", "permission-denied": "PermissionDenied",
}
# hook -> (span name, span kind, level, signal) for the zero-length markers
HOOK_MARKERS = {
    "PreCompact": ("context.compact", "CHAIN", 2, "compaction_mode"),
    "PostCompact": ("context.compacted", "CHAIN", 2, "compaction_mode"),
    "PostToolBatch": ("loop.tool_batch", "CHAIN", 4, "parallelism_index"),
    "TaskCreated": ("loop.task_created", "CHAIN", 4, "plan_structure"),
    "TaskCompleted": ("loop.task_completed", "CHAIN", 4, "plan_structure"),
    "PermissionDenied": ("harness.permission_denied", "GUARDRAIL", 3, "permission_friction"),
}
IDLE_SESSION_HOURS = 6

# --- run event log ---------------------------------------------------------------------------
REDACTED = "(contenu non capturé)"
TARGET_FIELDS = ["file_path", "path", "command", "pattern", "url", "description"]
VALUE_MARKER = "… [tronqué]"

# --- spend report header cues, first match wins ------------------------------------------------
SPEND_HEADER_CUES = [
    ("email", ["email", "user", "utilisateur", "membre"]),
    ("account", ["account", "uuid", "compte"]),
    ("product", ["product", "surface", "produit"]),
    ("model", ["model", "modèle", "modele"]),
    ("requests", ["request", "requête", "requete", "call", "appel"]),
    ("prompt", ["prompt", "input", "entrée", "entree"]),
    ("completion", ["completion", "output", "sortie"]),
    ("net", ["net"]),
    ("gross", ["gross", "brut"]),
    ("date", ["date", "day", "jour"]),
]

# --- format probe ----------------------------------------------------------------------------
CRITICAL_FIELDS = [
    ("assistant", "message"), ("assistant", "timestamp"), ("assistant", "sessionId"),
    ("user", "message"), ("user", "timestamp"), ("user", "sessionId"),
]
BROKEN_MIN_LINES, BROKEN_RATE = 50, 0.02

# --- alerts, trends, moments -------------------------------------------------------------------
UNDER_USE, OVER_USE = 0.5, 0.9
LOW_CACHE, OPUS_SHARE, HAIKU_SHARE, MONO_MIN_TASKS, DROP = 0.3, 0.95, 0.9, 5, -0.5
MAX_OBSERVATIONS, PROGRESS_FLOOR = 3, 0.12
MIN_POINTS, STREAK_WEEKS, MOVEMENT_FLOOR = 3, 3, 0.10
REWORK_MOMENT, FAILURE_MOMENT, FAILURE_MIN_CALLS, UNVERIFIED_MIN_CALLS = 3, 0.25, 8, 10
MIN_PROMPT_CHARS, MIN_PROMPT_COST = 12, 1.0

# --- info box fields: wiki field -> label --------------------------------------------------------
INFOBOX_FIELDS = [
    ("minerals", "minerai"), ("gas", "gaz"), ("supply", "supply"), ("buildtime", "temps de production"),
    ("hp", "points de vie"), ("shield", "boucliers"), ("armor", "armure"), ("range", "portée"),
    ("speed", "vitesse"), ("attack", "attaque"),
]

# --- claim rules -----------------------------------------------------------------------------
CLAIM_COMMON_WORDS = [
    "base", "bases", "partie", "parties", "carte", "armée", "armées", "compo", "composition",
    "build", "plan", "prompt", "tâche", "semaine", "attaque", "boucle", "outil", "outils",
    "économie", "production", "banque", "fenêtre", "scout", "harass", "drop", "test", "tests",
    "caméra", "replay", "ouverture", "timing", "engagement", "unité", "unités", "micro", "macro",
]
CLAIM_SIDE_NAMES = ["Zerg", "Terran", "Protoss", "Zergs", "Terrans", "Protosses"]
CLAIM_POSSESSIVE = r"\b(?:tes|ton|ta|mes|mon|ma|nos|notre)\s+([A-Za-zÀ-ÿ][\w'’-]*)"
CLAIM_THREAT = r"invisible|cloak|enterr"
CLAIM_DETECTION = r"détect"
CLAIM_ANTI_AIR = r"anti[- ]a[ée]rien|dans les airs|tire en l'air"
CLAIM_SCAN = r"\bscan\b"
CLAIM_CAPITALISED = r"(?<![.!?…]\s)(?<!^)\b([A-ZÀ-Þ][a-zà-ÿ]{2,}(?:\s+[A-ZÀ-Þ][a-zà-ÿ]+)?)\b"
CLAIM_OUTDATED = r"\b(\d{1,2})\s*(hatch|pool|gate|rax|nexus|ouvriers?|drones?)\b"

# --- signal specs: key, level, target, higher is better, ratio, problem --------------------------
SIGNAL_SPECS = [
    ("has_acceptance_criteria", 1, 0.60, True, True, "demande_non_executable"),
    ("rework_ratio", 1, 0.30, False, True, "demande_non_executable"),
    ("first_try_success", 1, 0.50, True, True, "demande_non_executable"),
    ("prompts_per_task", 1, None, True, False, "demande_non_executable"),
    ("context_pressure", 2, 0.80, False, True, "fenetre_subie"),
    ("cache_read_ratio", 2, 0.50, True, True, "fenetre_subie"),
    ("load_precision", 2, 0.40, True, True, "chargement_large"),
    ("context_isolation", 2, None, True, False, "fenetre_subie"),
    ("compaction_mode", 2, None, True, True, "fenetre_subie"),
    ("harness_breadth", 3, 4.0, True, False, "agent_non_equipe"),
    ("tool_failure_rate", 3, 0.15, False, True, "agent_non_equipe"),
    ("verification_present", 3, 0.70, True, True, "rien_ne_prouve"),
    ("skill_usage_rate", 3, None, True, True, "agent_non_equipe"),
    ("mcp_utilization", 3, None, True, True, "agent_non_equipe"),
    ("autonomy_ratio", 4, 8.0, True, False, "boucle_incomplete"),
    ("parallelism_index", 4, 0.15, True, True, "boucle_incomplete"),
    ("loop_closure", 4, 0.60, True, True, "boucle_incomplete"),
    ("plan_structure", 4, None, True, True, "boucle_incomplete"),
    ("graph_depth", 5, None, True, False, "echec_sans_lecon"),
    ("self_correction", 5, 0.50, True, True, "echec_sans_lecon"),
]
# problem, level, challenge signal, challenge target, higher is better, needs hooks
PROBLEMS = [
    ("demande_non_executable", 1, "has_acceptance_criteria", 0.6, True, False),
    ("fenetre_subie", 2, "compaction_mode", 0.7, True, True),
    ("chargement_large", 2, "load_precision", 0.4, True, False),
    ("agent_non_equipe", 3, "harness_breadth", 4.0, True, False),
    ("rien_ne_prouve", 3, "verification_present", 0.7, True, False),
    ("boucle_incomplete", 4, "loop_closure", 0.6, True, False),
    ("echec_sans_lecon", 5, "self_correction", 0.5, True, False),
]

# --- boundary reasons (formats) ------------------------------------------------------------------
REASON_FIRST = "premier tour de la session"
REASON_NO_PROMPT = "tour de continuation sans prompt"
REASON_SILENCE = "silence de %d min avant le prompt"
REASON_CORRECTIVE = "ouverture corrective « %s »"
REASON_UNFINISHED = "le tour précédent n'avait pas rendu la main"
REASON_CONTINUATION = "ouverture de continuation « %s »"
REASON_SHORT = "prompt court (%d car.) et référentiel"
REASON_NEW = "prompt autonome"
UNTITLED = "Travail sans prompt initial"
