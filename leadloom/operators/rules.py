"""The opportunity rules as data: constants, wording and codes of what stays unknown.

impact, confidence and fit are fixed values.  ``unknowns`` are codes, ``title`` and
``action`` our own wording.
"""

from typing import NamedTuple


class Rule(NamedTuple):
    type: str
    title: str
    impact: int
    confidence: int
    fit: int
    unknowns: tuple
    action: str
    healthcare_impact: int | None = None   # replaces impact in healthcare
    page_confidence: int | None = None     # replaces confidence when a fitting page was read


RULES = [
    Rule("appointment_lifecycle", "Automate the appointment cycle", 82, 76, 92,
         ("reminder_automation", "scheduling_integration"),
         "Check how bookings are confirmed, reminded, moved and followed up.",
         healthcare_impact=90, page_confidence=82),
    Rule("inquiry_conversion", "Answer inquiries faster", 87, 77, 94, ("inquiry_routing",),
         "Check who answers form inquiries, how fast, and what happens next.", page_confidence=84),
    Rule("consultation_conversion", "Turn consultations into clients", 84, 78, 93, ("consultation_process",),
         "Offer one request form for consultations, with reminders and follow-up."),
    Rule("intake_coordination", "Coordinate intake and referrals", 84, 83, 96, ("intake_ownership",),
         "Map the intake stages and automate document requests and status notes.", healthcare_impact=91),
    Rule("audience_routing", "Route each audience to the right desk", 88, 85, 95, ("routing_rules",),
         "Sort incoming requests by audience and follow up accordingly."),
    Rule("recruitment_workflow", "Handle applicants in one flow", 78, 80, 88, ("applicant_tracking",),
         "Automate applicant intake, screening and interview dates."),
    Rule("membership_conversion", "Win and keep members", 89, 84, 94, ("membership_systems",),
         "Automate sign-up, onboarding and renewal messages for members."),
    Rule("retention_reactivation", "Bring customers back", 86, 79, 92, ("recall_process",),
         "Find customers due for follow-up and remind them."),
    Rule("reputation_follow_up", "Ask for reviews", 65, 68, 86, ("review_requests",),
         "Ask for a review after each completed service."),
    Rule("commerce_lifecycle", "Automate the order cycle", 80, 82, 82, ("commerce_systems",),
         "Check order confirmations, abandoned carts and after-sales messages."),
    Rule("conversion_path", "Give visitors a way to convert", 72, 88, 84, ("other_conversion_paths",),
         "Add a form or booking path that can be measured."),
]
