"""Word lists, patterns, thresholds, prompt texts and benchmark items.

Everything in this module is a fixed value that has to be exactly as written for
results to agree with the behaviour being reproduced.  No logic lives here.
"""

# --- fixed values: chunking -------------------------------------------------

CHUNK_SIZE = 512
CHUNK_OVERLAP = 128
V1_CHUNK_OVERLAP = 50
CHARS_PER_TOKEN = 4
MIN_DOCUMENT_CHARS = 10
OCR_MIN_CHARS = 50
OCR_DPI = 300

SECTION_PATTERNS = [
    ("abstract", r"(abstract)"),
    ("introduction", r"(introduction|background)"),
    ("methods", r"(materials?\s+and\s+methods?|methods?|methodology|experimental)"),
    ("results", r"(results?(\s+and\s+discussion)?)"),
    ("discussion", r"(discussion)"),
    ("conclusion", r"(conclusions?|summary)"),
    ("references", r"(references?|bibliography|literature\s+cited)"),
]

SECTION_TAGS = [
    ("abstract", "[ABSTRACT]"),
    ("introduction", "[INTRO]"),
    ("background", "[INTRO]"),
    ("methods", "[METHODS]"),
    ("materials", "[METHODS]"),
    ("results", "[RESULTS]"),
    ("discussion", "[DISCUSSION]"),
    ("conclusion", "[CONCLUSION]"),
    ("references", "[REFERENCES]"),
    ("table", "[TABLE]"),
    ("figure", "[FIGURE]"),
]

# --- fixed values: retrieval ------------------------------------------------

N_CANDIDATES = 20
TOP_K = 10
MAX_ALIASES_PER_TERM = 2
MAX_ADDED_ALIASES = 6

DISTANCE_SUPPORTED = 0.45
DISTANCE_PARTIAL = 0.65
DISTANCE_INFERRED = 0.85
DISTANCE_NO_MATCH = 1.10
CONFIDENCE_LABELS = ["SUPPORTED", "PARTIALLY_SUPPORTED", "INFERRED", "UNSUPPORTED"]

SYNONYMS = [
    ("rust", ["bean rust", "Uromyces appendiculatus", "foliar rust", "leaf rust"]),
    ("white mold", ["Sclerotinia sclerotiorum", "sclerotinia", "stem rot"]),
    ("bcmv", ["bean common mosaic virus", "bean common mosaic necrosis virus", "BCMNV", "mosaic virus"]),
    ("bacterial blight", ["Xanthomonas axonopodis", "common bacterial blight", "CBB", "angular leaf spot"]),
    ("anthracnose", ["Colletotrichum lindemuthianum", "Colletotrichum"]),
    ("root rot", ["Fusarium", "Rhizoctonia", "Pythium", "fusarium root rot"]),
    ("halo blight", ["Pseudomonas syringae", "halo blight bacteria"]),
    ("bean golden mosaic", ["BGMV", "begomovirus", "whitefly transmitted"]),
    ("drought", ["water deficit", "water stress", "drought stress", "water limitation", "soil water"]),
    ("heat stress", ["high temperature stress", "heat tolerance", "thermal stress", "canopy temperature"]),
    ("low phosphorus", ["phosphorus deficiency", "P deficiency", "low P availability", "P stress"]),
    ("aluminum toxicity", ["Al toxicity", "acid soil", "aluminium stress"]),
    ("low nitrogen", ["nitrogen deficiency", "N stress", "nitrogen limitation"]),
    ("nitrogen fixation", ["N2 fixation", "biological nitrogen fixation", "BNF", "symbiotic fixation",
                           "Rhizobium", "nodulation", "nodule"]),
    ("photosynthesis", ["carbon assimilation", "net photosynthesis", "Pn", "CO2 assimilation"]),
    ("transpiration", ["water use efficiency", "WUE", "stomatal conductance"]),
    ("bean", ["common bean", "dry bean", "Phaseolus vulgaris", "navy bean", "pinto bean",
              "black bean", "kidney bean", "snap bean", "field bean", "garden bean"]),
    ("tepary bean", ["Phaseolus acutifolius", "tepary"]),
    ("lima bean", ["Phaseolus lunatus"]),
    ("soybean", ["Glycine max", "soya"]),
    ("yield", ["seed yield", "grain yield", "crop yield", "productivity", "pods per plant",
               "seeds per pod", "harvest index"]),
    ("quality", ["seed quality", "nutritional quality", "protein content", "cooking quality"]),
    ("maturity", ["days to maturity", "flowering date", "days to flowering", "phenology"]),
    ("plant architecture", ["growth habit", "stem strength", "lodging", "branching"]),
    ("variety", ["cultivar", "genotype", "accession", "line", "germplasm", "landrace"]),
    ("breeding", ["genetic improvement", "selection", "backcrossing", "recurrent selection"]),
    ("resistance", ["tolerance", "immunity", "protection", "defense mechanism"]),
    ("pyramiding", ["gene pyramiding", "stacking genes", "combining genes"]),
    ("marker-assisted", ["MAS", "molecular markers", "SSR markers", "SNP markers",
                         "marker-assisted selection", "marker-assisted breeding"]),
    ("qtl", ["quantitative trait loci", "quantitative trait locus", "QTL mapping", "loci"]),
    ("gwas", ["genome-wide association", "association mapping", "association study"]),
    ("indeterminate", ["climbing bean", "vining", "Type III", "Type IV growth habit"]),
    ("determinate", ["bush bean", "upright", "Type I", "Type II growth habit"]),
    ("intercropping", ["mixed cropping", "polyculture", "maize-bean system", "companion planting"]),
    ("herbicide", ["weed control", "herbicide application", "S-metolachlor", "2,4-D"]),
    ("fungicide", ["fungicide application", "disease control spray"]),
    ("fertilizer", ["nitrogen fertilizer", "phosphorus fertilizer", "fertilization"]),
    ("irrigation", ["supplemental irrigation", "drip irrigation", "furrow irrigation"]),
]

# --- fixed values: question routing -----------------------------------------

GREETINGS = [
    "hello", "hi", "hey", "howdy", "hiya", "greetings", "good morning",
    "good afternoon", "good evening", "how are you", "what's up", "whats up",
]
GREETING_TRAILERS = "!?. "

WELCOME_MESSAGE = (
    "Hello! I'm the research assistant. I can answer questions about "
    "bean and legume crop science based on 1,000+ research papers (1961–2026).\n\n"
    "Try asking something like:\n"
    "• What diseases affect bean crops and how can they be managed?\n"
    "• How does drought stress affect bean yield?\n"
    "• What nitrogen fixation rates have been reported for common bean?\n"
    "• How does intercropping beans with maize affect productivity?"
)
OUT_OF_SCOPE_MESSAGE = (
    "I couldn't find relevant research for that question in the database. "
    "This system is specialized for bean and legume crop science — try asking about "
    "bean diseases, drought tolerance, nitrogen fixation, breeding, or agronomic management."
)
MODEL_ERRORS = [
    ("401", "unauthorized", "HuggingFace authentication failed. Check HF_TOKEN."),
    ("429", "rate limit", "Rate limit reached. Please wait and try again."),
    ("503", "unavailable", "LLM service temporarily unavailable. Try again shortly."),
]
MODEL_ERROR_OTHER = "LLM error: "

YEAR_CHOICES = ["1961-2006", "2007-2026"]
SESSION_HELP = """
Commands:
  <question>          Ask any question about bean research
  /year 1961-2006     Filter to papers from 1961-2006
  /year 2007-2026     Filter to papers from 2007-2026
  /year off           Remove year filter
  /sources <n>        Set number of sources to retrieve (default: 10)
  /help               Show this help
  /quit               Exit
"""

# --- fixed values: prompts --------------------------------------------------

WEAK_EVIDENCE = "⚠ WEAK EVIDENCE"
WEAK_REFERENCE = " *(weak evidence)*"
REFERENCE_HEADING = "**References:**"
GAP_NOTE = (
    "NOTE: The retrieved sources may only partially address this question. "
    "Answer as fully as you can from the evidence, and briefly note any gaps."
)

SYSTEM_PROMPT = """You are an expert scientific assistant specializing in bean and legume crop science. \
You answer questions in clear, natural prose — like a knowledgeable colleague explaining findings from the research literature.

WRITING STYLE:
• Write in flowing paragraphs as your default style
• Integrate citations naturally into sentences, e.g. "Studies show yields of 2–3 t/ha under rainfed conditions (doi:10.1234/example, p.4)"
• Use specific numbers, units, and percentages whenever the papers provide them
• If multiple papers agree, synthesize them into a single clear statement
• If papers disagree or evidence is limited, say so plainly in natural language
• For multi-part questions, use short subheadings only if it genuinely aids clarity
• Use a markdown table ONLY when the question asks for a comparison or summary AND the sources contain enough actual data to fill the table meaningfully

TABLE RULES — follow these strictly:
• Only include a row in a table if the source explicitly reports a value for that row — NEVER leave cells empty or write "not reported"
• Do not invent rows for categories that are not mentioned in the sources
• Every data cell must have a real number from a source; if no number exists, omit that row entirely
• Keep tables small and accurate — 3 accurate rows are better than 8 rows with empty cells
• Always follow a table with a brief paragraph summarising the key takeaway

CITATION RULES:
• Cite ONLY using DOI format: (doi:10.XXXX/suffix, p.N)
• NEVER use numbered references like [1], [2], [Source 1], [Document 2] — these are forbidden
• Only cite a source when it directly supports the specific claim in that sentence
• Sources marked ⚠ WEAK EVIDENCE should only be cited when no stronger source exists

IMPORTANT:
• Never refuse to answer — give your best answer based on what the sources contain
• If the sources only partially address the question, answer what you can and briefly note what is not covered
• Do not mention confidence labels, retrieval systems, or internal scoring in your answer"""

# --- fixed values: answer scoring -------------------------------------------

RUBRIC_STOP_WORDS = ["the", "are", "for", "and", "that", "have", "been", "with", "from", "this"]
DOI_CITATION_PATTERN = r"doi:\s*10\.\d{4,}"
LABEL_PATTERN = r"\[(supported|partially_supported|inferred|unsupported)\]"

DEFAULT_QUESTIONS = [
    "What are the main diseases affecting bean crops and how can they be managed?",
    "What nitrogen fixation rates have been reported for common bean varieties?",
    "What soil pH and nutrient conditions are optimal for bean production?",
    "How does drought stress affect bean yield and what tolerance mechanisms exist?",
    "How has bean breeding improved resistance to bean common mosaic virus?",
    "How does intercropping beans with maize affect productivity?",
    "Why is pyramiding rust resistance genes from Middle American and Andean gene pools considered important?",
    "What explains the yield advantage of indeterminate over determinate bean varieties?",
    "What are the known limitations or challenges in breeding white mold resistance in dry beans?",
    "What gaps remain in understanding nitrogen fixation efficiency in common bean?",
    "What are the most effective herbicides used in bean cultivation, how do they work, and what are their risks?",
    "Compare the drought tolerance mechanisms of tepary bean versus common bean and explain the breeding implications.",
]

# (id, category, question, rubric)
BENCHMARK = [
    ("DL-01", "direct_lookup",
     "What nitrogen fixation rates have been reported for common bean (Phaseolus vulgaris) varieties?",
     ["specific numerical fixation rates (kg N/ha or % N derived from atmosphere)",
      "mention of Rhizobium or nodulation",
      "at least one cultivar or experimental condition"]),
    ("DL-02", "direct_lookup",
     "What soil pH range is considered optimal for common bean production?",
     ["pH range (typically 6.0–7.0)",
      "reference to nutrient availability or root health"]),
    ("DL-03", "direct_lookup",
     "What are the symptoms of bean rust caused by Uromyces appendiculatus?",
     ["description of pustules or uredinia",
      "leaf or stem symptoms",
      "mention of sporulation or color"]),
    ("DL-04", "direct_lookup",
     "What seed yield advantage has been reported for indeterminate over determinate bean varieties under field conditions?",
     ["numerical yield comparison (% or kg/ha)",
      "mention of growth habit type (Type I, II, III, IV)",
      "at least one study or environment cited"]),
    ("DL-05", "direct_lookup",
     "What herbicides are commonly used for weed control in dry bean production?",
     ["at least two herbicide names (e.g., S-metolachlor, imazethapyr, fomesafen)",
      "mention of application timing or target weed species"]),
    ("CS-01", "cross_section",
     "How has marker-assisted selection improved bean resistance to bean common mosaic virus (BCMV)?",
     ["identifies specific resistance genes or QTLs (e.g., I gene, bc-1, bc-3)",
      "describes how MAS is applied in breeding",
      "mentions genetic diversity or gene pools"]),
    ("CS-02", "cross_section",
     "How does intercropping common bean with maize affect bean yield and nitrogen fixation?",
     ["yield comparison (monoculture vs. intercrop)",
      "light or nutrient competition effects",
      "nitrogen fixation change (increase or decrease with rationale)"]),
    ("CS-03", "cross_section",
     "What is the role of phosphorus availability in nitrogen fixation efficiency in common bean?",
     ["mechanism linking P to nodulation or nitrogenase activity",
      "threshold P level or fertilization trial results",
      "interaction with soil pH or organic matter"]),
    ("CS-04", "cross_section",
     "How do drought stress and heat stress interact to affect bean pod set and seed filling?",
     ["separate effects of drought and heat on reproductive stage",
      "combined/interaction effects if reported",
      "mention of canopy temperature or water deficit measurement"]),
    ("CS-05", "cross_section",
     "How have bean yield improvements been achieved through genetic improvement vs. agronomic management since 1990?",
     ["distinguishes genetic gain from management-based yield increases",
      "references breeding programs or variety releases",
      "references agronomic practices (fertilization, planting density, irrigation)"]),
    ("IN-01", "inference",
     "Why is pyramiding rust resistance genes from both Middle American and Andean gene pools considered important for bean breeding programs?",
     ["explanation of gene pool diversity (Middle American vs. Andean)",
      "reason for combining genes (broader spectrum resistance or durability)",
      "mention of Uromyces races or pathogen variation"]),
    ("IN-02", "inference",
     "Why might tepary bean (Phaseolus acutifolius) be more drought-tolerant than common bean at the physiological level?",
     ["physiological mechanisms (deeper roots, reduced transpiration, osmotic adjustment)",
      "comparison with common bean",
      "at least one study or trait measurement cited"]),
    ("IN-03", "inference",
     "What explains why biological nitrogen fixation in common bean is often insufficient to meet crop nitrogen demand?",
     ["factors limiting BNF (carbon cost, soil mineral N, P deficiency)",
      "quantitative shortfall mentioned (kg N/ha fixed vs. required)",
      "interaction with Rhizobium strain or soil conditions"]),
    ("IN-04", "inference",
     "Why does early-season drought have a more severe effect on bean yield than late-season drought?",
     ["impact on flowering or pod set (vs. seed filling)",
      "critical period concept",
      "supporting data or study result"]),
    ("IN-05", "inference",
     "Why might low-input farming systems in sub-Saharan Africa benefit more from improved bean varieties than high-input systems?",
     ["yield gap argument (genetic potential vs. realized yield)",
      "role of disease resistance or adaptation in low-input contexts",
      "comparison of input-response between systems"]),
    ("CR-01", "critique",
     "What are the known challenges in breeding white mold (Sclerotinia sclerotiorum) resistance in dry beans?",
     ["complexity of host-pathogen interaction",
      "environmental variation in disease expression",
      "lack of complete resistance in germplasm",
      "difficulty of field screening"]),
    ("CR-02", "critique",
     "What methodological limitations affect the measurement of nitrogen fixation in field bean experiments?",
     ["15N isotope dilution or acetylene reduction assay limitations",
      "spatial or temporal variability in field trials",
      "reference plant selection issues"]),
    ("CR-03", "critique",
     "What gaps remain in understanding the genetic basis of drought tolerance in common bean?",
     ["complexity of quantitative inheritance",
      "environment-by-genotype interaction",
      "limited marker-trait associations or QTL stability"]),
    ("CR-04", "critique",
     "What are the limitations of using yield trials as the primary method for evaluating drought tolerance in bean breeding programs?",
     ["confounding factors in field yield trials",
      "inconsistency of drought timing across environments",
      "need for physiological or secondary traits"]),
    ("CR-05", "critique",
     "What are the barriers to adopting improved bean varieties among smallholder farmers in developing countries?",
     ["seed system or seed access issues",
      "market or cultural preference factors",
      "input cost or risk aversion"]),
    ("MP-01", "multi_part",
     "What are the most effective fungicides for bean rust management, "
     "how do they work mechanistically, and what resistance risks do they pose?",
     ["names at least two effective fungicide classes or active ingredients",
      "explains mode of action (sterol inhibition, respiration, etc.)",
      "addresses fungicide resistance risk or resistance management"]),
    ("MP-02", "multi_part",
     "Compare the drought tolerance mechanisms of tepary bean and common bean, "
     "and explain the implications for introgression breeding programs.",
     ["mechanism comparison (tepary vs. common bean physiology)",
      "crossability barriers or reproductive isolation issues",
      "practical implications for breeding (backcrossing, marker selection)"]),
    ("MP-03", "multi_part",
     "What soil amendments and inoculants have been used to enhance nitrogen fixation "
     "in common bean, what are their effects on yield, and what factors limit their adoption?",
     ["specific amendments or inoculants (Rhizobium, P fertilizer, organic matter)",
      "yield or fixation response data",
      "adoption barriers (cost, availability, farmer knowledge)"]),
    ("MP-04", "multi_part",
     "How does common bacterial blight (CBB) spread in bean fields, "
     "what resistance mechanisms have been identified, "
     "and which breeding strategies are most effective for durable resistance?",
     ["describes disease spread pathway (seed, rain splash, insects)",
      "identifies resistance QTLs or genes in Middle American or Andean germplasm",
      "discusses durability strategy (pyramiding, multilines, rotation)"]),
    ("MP-05", "multi_part",
     "What are the nutritional benefits of common beans for human health, "
     "what processing methods improve their bioavailability, "
     "and what genetic variation exists for key nutritional traits?",
     ["nutritional content (protein, iron, zinc, fiber, polyphenols)",
      "processing effects (soaking, cooking, fermentation) on anti-nutrients",
      "genetic variability in bean accessions for nutritional traits"]),
]
