"""Fixed values of the data model: states, dimensions, prototypes, keywords, thresholds and sizes."""

# Fixed values, as the data model has them.
EPISODE_STATES = ["needs_processing", "downloading", "transcribing", "indexing", "ready", "analyzing", "analyzed", "failed"]
DOCUMENT_STATES = ["needs_processing", "uploading", "indexing", "ready", "analyzing", "analyzed", "failed"]
INGEST_STATES = ["pending", "downloading", "downloaded", "transcribing", "transcribed", "indexing", "indexed", "completed", "failed", "skipped"]
TRUSTED_STATES = ["downloading", "transcribing", "indexing", "needs_processing", "failed"]
STATUS_ORDER = ["needs_processing", "downloading", "transcribing", "indexing", "failed", "ready", "analyzing", "analyzed"]

TREND_DIMENSIONS = {
    "adoption": ["Nascent experimentation", "Early adoption", "Crossing the chasm", "Established practice"],
    "expectation": ["Low", "Moderate", "High"],
    "progress": ["Near-term (0-12 months)", "Mid-term (1-3 years)", "Long-term (3+ years)"],
}
STAKE_DIMENSIONS = {
    "criticality": ["Low", "Moderate", "High"],
    "urgency": ["Long-term", "Mid-term", "Immediate"],
    "actionability": ["Hard to address", "Moderately addressable", "Highly addressable"],
}
DIMENSION_HINTS = {
    "adoption": "current practice, implementation, case examples, usage rate, market adoption",
    "expectation": "sentiment, attitudes, perception, expectations, interest, beliefs, consumer outlook",
    "progress": "timeline, roadmap, barriers, constraints, future outlook, development stage",
    "criticality": "burden, prevalence, severity, costs, public health priority, chronic disease, morbidity",
    "urgency": "accelerating, rising fast, now, immediate pressure, near-term risk, policy push, post-pandemic",
    "actionability": "food-first, feasible levers, credible claims, evidence, formulation, consumer clarity, differentiation",
}
PROTOTYPES = {
    "Metabolic Health & Lifestyle-Driven Conditions": "metabolic health diabetes obesity overweight insulin resistance blood sugar glucose weight management weight loss appetite satiety nutrition diet lifestyle chronic disease cardiovascular cholesterol lipids triglycerides hypertension prevention metabolic fitness protein fiber low sugar low carb glycemic index biohacking",
    "Mental, Emotional & Cognitive Well-Being": "mental health cognition cognitive brain focus memory mood stress anxiety depression burnout sleep relaxation mindfulness emotional resilience psychology wellbeing nervous system neurotransmitters magnesium adaptogens omega-3 gut brain axis stress management",
    "Women's Health & Hormonal Balance": "women health female health hormones hormonal balance menstrual cycle menopause perimenopause fertility pregnancy postpartum reproductive health estrogen progesterone pcos endometriosis bone density iron deficiency maternal health lifecycle endocrine",
    "Healthy Aging, Longevity & Vitality": "aging longevity lifespan healthspan vitality senior elderly frailty sarcopenia autonomy anti aging prevention cellular health regeneration senescence telomeres NAD sirtuins cognitive decline mobility bone health muscle mass independence",
    "Immunity & Gut Health": "immunity immune system gut health microbiome digestion digestive health inflammation probiotics prebiotics synbiotics fermented intestinal barrier leaky gut infection resistance respiratory immunity vitamins zinc vitamin D vitamin C autoimmune sensitivities microbiota",
    "Physical Resilience & Performance": "physical resilience performance fitness strength endurance stamina recovery mobility coordination posture balance motor skills musculoskeletal joints tendons bones physical development children youth adults training rehabilitation injury prevention sedentary lifestyle body literacy functional capacity",
}
OTHER = "Other"
KEYWORDS = ["diet", "nutrition", "health", "mental health", "longevity", "fitness", "well-being", "biohacking", "sleep", "wellness", "gut", "microbiome", "metabolism", "fasting", "supplements", "stress", "anxiety", "depression", "brain", "cognitive"]
FORMATS = ["pdf", "txt", "md", "docx"]

MACRO_THRESHOLD, STRATEGIC_THRESHOLD, DEDUP_THRESHOLD, MIN_CLUSTER = 0.72, 0.5, 0.90, 2
TOP_K, MIN_SIMILARITY, MAX_CONTEXT, CHUNK_OVERLAP_LIMIT = 3, 0.4, 200_000, 0.9
CHUNK_MIN, CHUNK_MAX, CHUNK_OVERLAP_SENTENCES = 400, 3600, 2
WINDOW_SIZE, WINDOW_OVERLAP, WINDOW_SEARCH = 250_000, 2_000, 1_000
