"""Word lists, patterns and limits that results depend on, stated as they must be."""

# Fixed values. Words without recall load, dropped from content tokens.
CONTENT_STOPWORDS = frozenset("""
    a an the and or but if then than that this these those with without within for from into onto
    over under above below between across through during is are was were be been being has have
    had do does did can could will would shall should may might must of to in on at by as it its
    their there here we us our you your which what when where while both each any all some such
    same other another more most less least very much many few one two also thus hence therefore
    so because since given note that follows follow obtain obtained yields yield gives give write
    writing written let letting using use used apply applying applied where above below step form
""".split())  # fmt: skip

# Fixed values. Words of a technique's name that don't identify it.
TECHNIQUE_STOPWORDS = frozenset("derivation identities identity notation rule method technique solve of the a and to for by".split())

# Fixed values. Words of a node's name that match everything in a repository.
GENERIC_WORDS = frozenset("""
    matrix model function value state data type form rule space vector transform distribution
    variable identity theorem expansion linear general probability change update total order point
    index limit scale offset delta angle penalty length count range
""".split())  # fmt: skip

# Fixed values. Words of a title that stay lower-case unless first, and acronyms.
SMALL_WORDS = ("of", "the", "to", "and")
ACRONYMS = ("pca", "icp", "pid", "lqr", "iou", "so3", "se3", "svd")

# Fixed values. Phrases of a page that lists meanings.
DISAMBIGUATION_PHRASES = ("may refer to", "may also refer to", "commonly refers to")

# Fixed values. Words that mark the paragraphs a derivation is in.
DERIVATION_MARKERS = ("deriv", "proof", "formulation", "solution", "estimation", "algorithm", "update", "predict", "optimal", "minimiz", "least squares")

# Fixed values. Headings that promise a derivation, and those that prove something about an object instead.
DERIVATION_TITLE = r"(?i)^\s*(proof|derivation|deriving)"
OUT_OF_SCOPE_TITLE = r"(?i)(\b(equivalen|existence|uniqueness|convergen|consisten|measurab|asymptotic|unbiased)|\bproofs?\s+(by|for)\b)"

# Fixed values. Verbs of a derivation being performed, and phrases that define an object.
MOVES = (
    r"\b(substitut\w*|rearrang\w*|expand\w*|therefore|hence|it follows|we obtain|we get|yields?|thus|equating|"
    r"differentiat\w*|integrat\w*|plugging|multiply\w* both sides)\b"
)
DEFINES = r"(\b(is a (linear )?(map|function|homomorphism|operator|transformation)\b|is called (a|an)\b|is defined to be\b))"

# Fixed values. Invocations that identify nothing.
UNINFORMATIVE = ("algebraic_rearrangement", "index_notation")

# Fixed values. Domains of further reading with their kinds, in order, and links that are none.
TRUSTED_DOMAINS = (
    (".edu", "course notes"), ("ac.uk", "course notes"), ("mathworld.wolfram.com", "reference"), ("cambridge.org", "book"), ("springer", "book"),
    ("arxiv.org", "preprint"), ("doi.org", "paper"), ("ieee.org", "paper"), ("ieeecss.org", "paper"), ("acm.org", "paper"), ("jstor.org", "paper"),
    ("sciencedirect", "paper"), ("nature.com", "paper"), ("ncbi.nlm.nih.gov", "paper"),
)
JUNK_LINKS = r"(?i)(web\.archive\.org|books\.google|amazon\.|youtube\.com|twitter\.com|facebook\.com|/rss|\.xml$|archive\.today)"

# Fixed values. Topics, parameters that name an output, and bridge arguments.
TOPIC = r"^/[A-Za-z_][A-Za-z0-9_/]*$"
OUTPUT_NAME = r"(publish|output|(^|_)out($|_))"
BRIDGE = r"^(/?[A-Za-z0-9_/]+)@[A-Za-z0-9_/]+([\[\]@])[A-Za-z0-9_.]+$"

# Fixed values. Parameters that tell copies of a component apart.
TELLING = r"(frame|topic|_config$|mode|enable|publish|broadcast|source|child|world|map|odom|base_link|datum|magnetic|yaw_offset|two_d|frequency)"

# Fixed values. Lines and files that are never evidence.
NEVER_EVIDENCE = r"^\s*(#|//|\*|import\b|from\b\s+\S+\s+import\b|\s*<!--)"
WIRING_FILE = r"((^|/)test_[^/]*$|/test/|\.xml$|\.launch\.py$)"

# Fixed values. A heading that promises a derivation, with its marks, and what it adds to a paragraph's score.
DERIVATION_HEADING = r"(?i)^\s*=+\s*(proof|derivation|deriving)"
HEADING_BONUS = 400

# Fixed values. Relations of a code graph that are flows, and files that start nodes.
FLOW_RELATIONS = ("shares_data_with", "rationale_for", "calls")
LAUNCH_FILE = r"\.launch\.(py|xml|ya?ml)$"

# Fixed values. The parameter of an address that carries a key.
KEY_PARAMETER = r"(key=)[A-Za-z0-9_\-]+"

# Fixed values. Why a proposed edge is rejected, in the order of the tests.
REJECTIONS = (
    "unknown source id", "unknown target id", "self-edge", "edge out of a floor node", "edge out of a seed algorithm",
    "dropped by amendment", "duplicate", "over branching cap of",
)

# Fixed values. Why a record goes, in the order of the tests.
PRUNE_REASONS = (
    "unreadable", "predates kind branching", "definition with no properties", "technique stated instead of performed",
    "every step invokes only floor-level trivia", "no substantive invocations, closure check was vacuous",
)

# Fixed values. What a hand-written brief may claim that is not there.
BRIEF_PROBLEMS = (
    "components in a subsystem but never described", "components described but in no subsystem", "algorithms not in the canon", "files not found in the repo",
)

# Fixed values. Titles that name a server's state or a section, and site names after a title.
NOT_A_TITLE = (
    r"(?i)^(home|index of|404|page not found|not found|access denied|just a moment|redirect|error|attention required|untitled|document|"
    r"client challenge|are you a robot|captcha|wyszukiwanie)\b|^[\w.-]+\.[a-z]{2,}$|^(search|computer science|mathematics|statistics|physics)$"
)
SITE_SUFFIX = r"\s+(?:\||--)\s+.*$"

# Fixed values. Names in package manifests and launch files, calls that leave a value open, and calls that open topics.
DEPENDENCY_TAGS = ("depend", "build_depend", "exec_depend", "run_depend")
PARAMETER_SUFFIXES = (".yaml", ".yml")
SUBSTITUTIONS = ("LaunchConfiguration", "PathJoinSubstitution", "FindPackageShare", "ParameterFile")
TOPIC_CALLS = {"create_publisher": "publishes", "create_subscription": "subscribes"}

# Fixed values. Keys of documents in their addresses, which record an address cites, and suffixes of pages.
ARXIV_KEY = r"(?i)arxiv\.org/(?:abs|pdf)/([\w.\-/]+?)(?:v\d+)?(?:\.pdf)?/?$"
DOI_KEY = r"(?i)doi\.org/(10\.[^?#\s]+)"
JSTOR_KEY = r"(?i)jstor\.org/stable/(\d+)"
ISBN_KEY = r"(97[89](?:[-\s]?\d){10})"
CITATION_KINDS = (
    ("arxiv", r"arxiv\.org/(abs|pdf)/"), ("doi", r"(doi\.org/|/doi/)10\."), ("jstor", r"jstor\.org/stable/"),
    ("isbn", r"isbn[:/=]?[0-9x-]{10,}"), ("pdf", r"\.pdf($|[?#])"),
)
PAGE_SUFFIX = r"(?i)\.(pdf|html?|php|aspx)$"
