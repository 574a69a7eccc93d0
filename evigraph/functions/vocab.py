"""Controlled vocabularies and fixed values of the data model.

Everything in this module is a fixed value that results depend on.
"""

# Enumerations of the data model.
ENDPOINT_TYPES = ["Person", "Work", "Concept", "Movement", "Institution"]
CLAIM_STATUSES = ["observed", "candidate", "accepted", "rejected", "stale", "conflicting"]
EDGE_STATUSES = ["suggested", "accepted", "rejected", "needs_source"]
DEAD_CLAIM_STATUSES = ["rejected", "stale", "conflicting"]

# Relationship types (typed ones with their endpoint types).
TYPED_RELATIONSHIPS = {
    "person authored work": ("Person", "Work"),
    "work introduced concept": ("Work", "Concept"),
    "person influenced person": ("Person", "Person"),
    "person mentored person": ("Person", "Person"),
    "person collaborated with person": ("Person", "Person"),
    "person participated in movement": ("Person", "Movement"),
    "person affiliated with institution": ("Person", "Institution"),
    "concept shaped movement": ("Concept", "Movement"),
    "work influenced work": ("Work", "Work"),
}
LEGACY_RELATIONSHIPS = [
    "Collaboration", "Critique", "Friendship", "Indirect influence", "Influence", "Mentorship",
    "Parallel", "Parallel development", "Recorded influence", "Rivalry",
    "Source-context neighbor",
]
VALID_RELATIONSHIPS = LEGACY_RELATIONSHIPS + list(TYPED_RELATIONSHIPS)
NON_DIRECTIONAL = [
    "Collaboration", "Critique", "Friendship", "Parallel", "Parallel development", "Rivalry",
    "Source-context neighbor", "person collaborated with person",
]

# Acceptance thresholds in hundredths (accept, provisional).
ACCEPTANCE_HUNDREDTHS = {
    "identity": (90, 70),
    "basic_metadata": (75, 55),
    "external_id": (70, 50),
    "work_metadata": (75, 55),
    "institution_affiliation": (80, 60),
    "direct_influence": (92, 75),
    "relationship": (85, 65),
}
STRICT_HUNDREDTHS = {
    "direct_influence": 5, "canonical_thread_edge": 4, "cross_century_jump": 4,
    "high_bridge_score_node": 3, "disputed_or_sparse_topic": 4,
}
LOOSE_HUNDREDTHS = {
    "basic_metadata": 4, "stable_external_id": 6, "work_stable_identifier": 5,
    "direct_institution_source": 4,
}

# Claim status ranks used by the changelog.
CLAIM_STATUS_RANK = {
    "accepted": 5, "candidate": 4, "observed": 3, "stale": 2, "conflicting": 1, "rejected": 0,
}

# Era bands [start, end) in years, and the importers' upper bounds.
ERA_BANDS = [
    (-600, 500, "Ancient"), (500, 1400, "Medieval"), (1400, 1600, "Renaissance"),
    (1600, 1700, "Scientific Revolution"), (1700, 1800, "Enlightenment"),
    (1800, 1900, "19th Century"), (1900, 1945, "Modernism"), (1945, 1980, "Postwar"),
    (1980, 2030, "Contemporary"),
]
IMPORT_ERA_BOUNDS = [
    (500, "Ancient"), (1400, "Medieval"), (1600, "Renaissance"), (1800, "Enlightenment"),
    (1900, "19th Century"), (1945, "Modernism"), (1980, "Postwar"),
]

# Field taxonomy.
FIELD_DOMAINS = {
    "Formal Systems": ["Mathematics", "Logic", "Computing"],
    "Natural Inquiry": [
        "Physics", "Astronomy", "Cosmology", "Chemistry", "Biology", "Engineering",
    ],
    "Human Systems": [
        "Philosophy", "Political Thought", "Economics", "History", "Psychology", "Linguistics",
    ],
    "Arts & Interpretation": ["Literature", "Music"],
}
BROAD_FIELDS = ["Other", "Unclassified", "Philosophy"]

# Controlled topics as field -> group -> topics.
TOPIC_GROUPS = {
    "Mathematics": {
        "Structures": ["Geometry", "Algebra", "Topology"],
        "Change & Quantity": ["Analysis", "Number Theory"],
        "Uncertainty": ["Probability"],
    },
    "Logic": {
        "Formal Systems": ["Formal Logic", "Foundations"],
        "Language": ["Language & Meaning"],
        "Computation": ["Computability"],
    },
    "Computing": {
        "Core Theory": ["Computation", "Information Theory", "Algorithms"],
        "Systems": ["Networks"],
        "Intelligence": ["Artificial Intelligence"],
    },
    "Physics": {
        "Classical Nature": ["Mechanics", "Optics", "Thermodynamics"],
        "Fields & Matter": ["Electromagnetism", "Quantum Theory"],
        "Space & Time": ["Relativity"],
    },
    "Astronomy": {
        "Observation": ["Observation", "Cosmic Distance"],
        "Models": ["Celestial Mechanics", "Planetary Models"],
    },
    "Cosmology": {
        "Large-Scale Structure": ["Universe Structure", "Expansion"],
        "Extreme Objects": ["Black Holes", "Dark Matter"],
        "Origins": ["Early Universe"],
    },
    "Chemistry": {
        "Matter": ["Atomic Theory", "Bonding", "Materials"],
        "Life & Method": ["Biochemistry", "Laboratory Method"],
    },
    "Biology": {
        "Organisms": ["Anatomy", "Ecology"],
        "Lineage": ["Evolution", "Genetics"],
        "Molecular Life": ["Molecular Biology"],
    },
    "Engineering": {
        "Machines & Energy": ["Machines", "Energy Systems"],
        "Built Systems": ["Aerospace", "Communication Systems", "Infrastructure"],
    },
    "Philosophy": {
        "Reality & Knowledge": ["Metaphysics", "Epistemology"],
        "Value & Action": ["Ethics"],
        "Mind & Language": ["Mind", "Language"],
        "Inquiry": ["Science & Method"],
    },
    "Political Thought": {
        "Authority": ["State Power", "Democracy", "Revolution"],
        "Norms": ["Rights", "Justice"],
        "Material Order": ["Political Economy"],
    },
    "Economics": {
        "Exchange": ["Markets", "Value"],
        "Systems": ["Macroeconomics", "Institutions"],
        "Strategic Action": ["Game Theory"],
    },
    "History": {
        "Method": ["Historical Method"],
        "Collective Life": ["Civilization", "Culture", "Technology & Society"],
    },
    "Psychology": {
        "Mind": ["Cognition", "Consciousness"],
        "Behavior": ["Behavior", "Development", "Social Psychology"],
    },
    "Linguistics": {
        "Structure": ["Grammar", "Language Structure"],
        "Meaning": ["Signs & Meaning", "Cognitive Linguistics"],
    },
    "Literature": {
        "Form": ["Poetics", "Narrative"],
        "Historical Modes": ["Modernism", "Political Literature", "Critical Theory"],
    },
    "Music": {
        "Form": ["Composition", "Harmony", "Theory"],
        "Practice": ["Performance", "Cultural Form"],
    },
}

# Lens -> option -> (label, keywords).
LENSES = {
    "problem": {
        "knowledge": ("Knowledge", ["epistemology", "logic", "method", "foundations", "signs",
                                    "meaning", "grammar"]),
        "matter": ("Matter & Nature", ["physics", "chemistry", "matter", "atomic", "mechanics",
                                       "thermodynamics", "materials"]),
        "life": ("Life", ["biology", "evolution", "genetics", "anatomy", "ecology",
                          "molecular"]),
        "mind": ("Mind", ["mind", "psychology", "cognition", "consciousness", "behavior"]),
        "order": ("Society & Order", ["political", "economics", "state", "rights", "justice",
                                      "democracy", "institutions", "history"]),
        "form": ("Form & Expression", ["literature", "music", "poetics", "narrative",
                                       "composition", "harmony", "critical"]),
        "computation": ("Computation", ["computing", "computation", "algorithms", "information",
                                        "artificial intelligence", "networks"]),
        "cosmos": ("Cosmos", ["astronomy", "cosmology", "celestial", "planetary", "universe",
                              "black holes", "expansion"]),
    },
    "method": {
        "proof": ("Proof & Formalization", ["mathematics", "logic", "proof", "formal",
                                            "geometry", "algebra", "topology", "foundations"]),
        "experiment": ("Experiment", ["experiment", "laboratory", "observation", "empirical",
                                      "scientific method"]),
        "modeling": ("Models & Systems", ["model", "systems", "networks", "simulation",
                                          "mechanics", "economics"]),
        "critique": ("Critique", ["critique", "deconstruction", "power", "critical",
                                  "political", "feminism"]),
        "interpretation": ("Interpretation", ["interpretation", "hermeneutics", "literature",
                                              "history", "culture", "language"]),
        "synthesis": ("Synthesis", ["synthesis", "polymath", "humanism", "interdisciplinary",
                                    "bridge"]),
    },
    "role": {
        "founder": ("Founder", ["founded", "father of", "first", "pioneered", "invented",
                                "created"]),
        "formalizer": ("Formalizer", ["formalized", "axiomatic", "systematic", "codified",
                                      "proved", "defined"]),
        "transmitter": ("Transmitter", ["translated", "commentaries", "transmitted",
                                        "popularized", "communicator"]),
        "critic": ("Critic", ["critic", "challenged", "response", "argued against",
                              "deconstruct"]),
        "connector": ("Connector", ["bridge", "synthesized", "linked", "combined",
                                    "integrated"]),
    },
}

# Words ignored when evidence texts are compared.
EVIDENCE_STOPWORDS = [
    "philosopher", "mathematician", "scientist", "writer", "known", "notable", "theory",
    "school",
]
