"""Word lists and patterns of the text probes and claim detectors.

Fixed values: results depend on every entry, so they are stated as they are.
"""

STOP_WORDS = "the and for are but not all can had was one our out did its get may say she too use".split()

JARGON = "advanced seamless intelligent robust scalable innovative optimised synergistic platform solution engine experience world-class next-generation transformative".split()

FAKE_MECHANISMS = [
    "leveraging our advanced",
    "through intelligent automation",
    "using our seamless",
    "synergistically optimises",
    "powered by advanced technology",
    "next-generation solution",
    "our innovative platform",
]

ACTION_WORDS = "save reduce increase identify surface flag detect show track measure rank eliminate convert automate close discover build test map trace score filter parse".split()
DOMAIN_NOUNS = "account customer churn revenue sprint ticket objection pipeline backlog query report metric team lead deal conversion retention candidate review onboarding approval deployment".split()

PROBLEM_MARKERS = ["instead of", "no more", "stop ", "tired of", "without ", "before ", "chasing", "waiting", "guessing", "struggling"]
MECHANISM_MARKERS = ["by ", "because", "through", "uses ", "connects", "maps ", "traces", "flags ", "surfaces", "ranks ", "so that"]
RESULT_MARKERS = [" so ", "which means", "enabling", "giving", "letting", "making it", "so you can", "so your"]

WINDOW_MARKERS = ["by ", "because", "so that", "which means", "through ", "enables", "allows", "helps "]
CONCRETE_TERMS = "backlog ticket account customer sprint pipeline lead query report code review objection onboarding approval metric signal pattern record item step rule flag threshold".split()

SPECIFIC_VERBS = "identify surface flag detect show track rank eliminate convert automate".split()

CAUSAL_MARKERS = ["because", "since", "therefore", "which means", "so that", "works by", "based on", "through", "by ", "as a result", "enables", "allows", "helps", "leading to"]

GENERAL_VERBS = "identify surface flag detect show track rank save reduce increase eliminate convert automate close".split()
ABSTRACT_WORDS = "solution platform system framework innovation experience value quality seamless advanced intelligent robust scalable".split()

BEFORE_STATE = ["instead of", "rather than", "no more", "used to", "stop ", "tired of", "struggling", "without having to"]

HYPE_FLAGS = ["best", "ultimate", "revolutionary", "game-changing", "groundbreaking", "effortless", "instant", "guaranteed", "amazing", "incredible", "unmatched", "world-class", "perfect", "magic"]

HEDGES = ["often", "may ", "typically", "for many", "in most", "usually", "can ", "sometimes"]
SUPERLATIVES = ["best", "ultimate", "revolutionary", "groundbreaking", "guaranteed", "amazing", "incredible", "effortless", "instant", "world-class", "perfect"]

CLAUSE_MECHANISMS = ["by ", "through ", "using "]
CLAUSE_RESULTS = ["so ", "which means", "enabling", "letting"]
CLAUSE_ACTIONS = "flag detect track filter parse rank score surface identify measure map trace pull push check validate run test scan block alert connect generate extract classify match compare automate schedule trigger log monitor tag".split()
CLAUSE_OBJECTS = "account ticket lead pipeline backlog query report metric sprint deal customer threshold pattern signal record item step rule variant page email conversion engagement response request deploy review change code test error alert log".split()
CLAUSE_CONSEQUENCES = "save reduce increase improve eliminate avoid prevent unblock close convert retain accelerate simplify prioritise prioritize focus spend start intervene prepare answer resolve ship deploy".split()
CLAUSE_OPERATIONS = "time cost revenue churn conversion retention approval deployment session meeting review sprint week day hour minute production evidence decision conversation account team work reply response".split()
CLAUSE_JARGON = "advanced seamless intelligent robust scalable innovative optimised optimized synergistic synergistically platform solution engine experience world-class next-generation transformative revolutionary leveraging".split()

NUMBER = r"\b\d+(?:\.\d+)?%?\b"
CAPITALISED = r"\b[A-Z][a-z]{2,}\b"
NUMERIC_WORDS = ["thousands", "millions", "billions", "triple", "quadruple", "dozens", "hundreds", "double", "twice", "tenfold", "hundredfold"]
TIME_QUANTITY = [
    r"\b\d+x\s+faster\b",
    r"\b\d+x\s+more\b",
    r"\b\d+x\s+better\b",
    r"\b\d+\s*%\s*(?:faster|better|more|less|improvement|reduction|increase)\b",
    r"\b\d+\s*(?:seconds|minutes|hours|days|weeks|months)\s+(?:faster|sooner|quicker)\b",
]
GUARANTEES = ["guaranteed", "100%", "always", "never fails", "zero errors", "perfectly", "zero downtime", "100 percent", "flawless", "infallible"]
AWARDS = ["award-winning", "award winning", "certified", "certification", "soc2", "soc 2", "iso", "hipaa", "gdpr compliant", "pci", "compliant", "compliance", "accredited", "accreditation", "patent", "patented"]
CUSTOMER_CLAIMS = [
    r"\bfortune\s+\d+\b",
    r"\benterprise\s+clients?\b",
    r"\b\d+\+?\s+(?:companies|customers|clients|organizations|teams)\b",
    r"\b(?:trusted\s+by|used\s+by|chosen\s+by)\s+\d+",
]
COMPANY_NAME = r"\b[A-Z][a-z]+\s+(?:Corp|Inc|LLC|Ltd|Co|Group|Holdings)\b"
