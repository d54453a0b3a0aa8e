"""Word lists, thresholds and rule constants the results depend on.

Everything in this module is data.  The lists keep their natural order because
several operators report the first or all matching entries in list order.
"""

import html.entities

# --- page quality -----------------------------------------------------------
MIN_HTML_CHARS = 500
MIN_TEXT_CHARS = 100
BLOCK_PHRASES = [
    "access denied", "forbidden", "verify you are human", "verify you are a human",
    "checking your browser", "checking your browser before accessing", "just a moment",
    "attention required", "cf-chl", "cloudflare", "captcha",
    "enable javascript and cookies", "unusual traffic", "bot detection",
]

# --- contacts ---------------------------------------------------------------
GHOST_DOMAINS = [
    "zendesk.com", "intercom.com", "drift.com", "hubspot.com", "facebook.com",
    "google.com", "sentry.io", "example.com", "email.com", "yelp.com",
    "squarespace.com", "grammarly.com",
]
TOLL_FREE = ["800", "833", "844", "855", "866", "877", "888"]

# --- page features, also the text fallback of the same signals ---------------
FEATURES = {
    "booking": ["book online", "book an appointment", "schedule an appointment",
                "schedule a consultation", "schedule your appointment", "appointment request",
                "appointments", "make an appointment", "book now", "reserve now"],
    "social": ["facebook.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com",
               "x.com/", "twitter.com"],
    "ecommerce": ["add to cart", "shopping cart", "checkout", "shop now", "buy now",
                  "product catalog"],
    "reviews": ["reviews", "testimonials", "google reviews", "patient reviews",
                "customer reviews", "what our clients say"],
    "newsletter": ["newsletter", "subscribe to our", "subscribe for updates", "email updates",
                   "join our mailing list"],
    "live_chat": ["live chat", "chat with us", "chat now", "online chat", "start a chat"],
    "review_cta": ["leave a review", "write a review", "review us", "review on google"],
}
FORM_FIELD_WORDS = ["name", "full name", "first name", "last name", "email", "phone", "message",
                    "subject", "company"]
FORM_ACTION_WORDS = ["submit", "send message", "send us a message", "get a quote", "request",
                     "contact us", "get started"]
CTA_WORDS = ["book", "schedule", "contact", "request", "quote", "get started", "call now",
             "learn more", "buy now", "shop now"]
FORM_DETAILS_KEPT = 5
FORM_LABEL_CHARS = 120
FORM_TEXT_CHARS = 300

# --- site assembly ----------------------------------------------------------
SUBPAGE_WORDS = {"contact": 0, "about": 1, "team": 2, "service": 3}
SUBPAGES_KEPT = 3
SITE_TEXT_CHARS = 15000
PREVIEW_CHARS = 500
DIRECTORY_DOMAINS = ["zoominfo.com", "crunchbase.com", "linkedin.com", "facebook.com"]
WEBSITE_LINK_TEXTS = ["Visit Website", "Business Website", "Official Site", "Website"]
WEBSITE_LINK_HREF = "biz_redir"
WEBSITE_LINK_TESTID = "bizWebsiteLink"

# --- signals ----------------------------------------------------------------
SIGNALS = ["contact_page", "booking", "lead_form", "phone", "email", "services", "social",
           "ecommerce", "reviews", "newsletter", "live_chat", "review_cta"]
CONTACT_WORDS = ["contact us", "contact page", "get in touch", "contact information",
                 "contact details", "reach us", "contact/"]
SERVICE_SIGNAL_WORDS = ["our services", "services", "what we do", "treatments", "specialties",
                        "solutions", "service areas"]
TEXT_FORM_FIELD_WORDS = ["your name", "full name", "first name", "last name", "email address",
                         "phone number", "your email", "message", "subject"]
TEXT_FORM_ACTION_WORDS = ["submit", "send message", "send us a message", "get a quote", "request"]

# --- classification ---------------------------------------------------------
INDUSTRIES = {
    "healthcare": ["medical clinic", "medicalclinic", "physician", "doctor", "healthcare",
                   "telemedicine", "primary care", "family medicine", "hospital", "dentist"],
    "real_estate": ["real estate", "realtor", "property management", "homes for sale"],
    "ecommerce": ["ecommerce", "add to cart", "checkout", "shop now"],
    "legal": ["law firm", "attorney", "legal services"],
    "accounting": ["accounting", "bookkeeping", "tax preparation"],
    "home_services": ["plumbing", "electrician", "handyman", "roofing", "hvac", "contractor"],
}
SERVICES = ["primary care", "telemedicine", "family medicine", "urgent care", "consulting",
            "bookkeeping", "accounting", "real estate", "property management", "plumbing",
            "electrical", "roofing", "hvac"]
AUDIENCES = {
    "patients": ["patient", "patients", "new patient", "new patients"],
    "clients": ["client", "clients", "customer", "customers"],
    "families": ["family", "families", "caregiver", "caregivers"],
    "referrers": ["referral", "referrals", "referring", "physician referral"],
    "professionals": ["professionals", "providers", "provider", "supervision", "consultation"],
    "employees": ["careers", "career", "jobs", "hiring", "join our team", "employment"],
    "members": ["membership", "member", "members", "monthly membership"],
}
WORKFLOWS = {
    "intake": ["intake", "patient forms", "new patient forms", "application", "registration",
               "enrollment"],
    "consultation": ["free consultation", "free consult", "consultation", "discovery call",
                     "initial consultation"],
    "referral": ["referral", "referrals", "refer a patient", "referring provider"],
    "follow_up": ["follow-up", "follow up", "followup", "ongoing care", "after your visit",
                  "after your appointment"],
    "recall": ["recall", "re-care", "reactivation", "return visit", "come back",
               "regular visits"],
    "financing": ["financing", "payment plan", "insurance", "insurance accepted",
                  "pay your bill"],
    "care_coordination": ["care coordination", "care coordinator", "coordinate care",
                          "case management"],
    "recruitment": ["apply", "careers", "jobs", "join our team", "employment", "hiring"],
    "membership": ["membership", "member benefits", "monthly fee", "membership plans"],
    "multi_service": ["services", "programs", "treatments", "specialties", "service areas"],
}
ANALYSIS_VERSION = "phase4-v2"

# --- scoring ----------------------------------------------------------------
WEIGHT_IMPACT, WEIGHT_CONFIDENCE, WEIGHT_FIT = 0.45, 0.30, 0.25
WEIGHT_TOP, WEIGHT_SECOND = 0.75, 0.25
BAND_HIGH, BAND_MEDIUM, BAND_LOW = 80, 60, 40

# --- character references ---------------------------------------------------
# Built by rule from the standard library: the HTML 4 names, plus every newer
# name that stands for one ASCII character (they can hide an address).
ENTITIES = {f"&{name};": chr(code) for name, code in html.entities.name2codepoint.items()}
ENTITIES["&apos;"] = "'"
ENTITIES.update({f"&{name}": value for name, value in html.entities.html5.items()
                 if name.endswith(";") and len(value) == 1 and value.isascii()})
