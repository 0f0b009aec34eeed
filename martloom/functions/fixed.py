"""Fixed values of the business rules: lookup tables, code sets, labels and texts."""

# State -> region of the default (Brazilian) geography.
STATE_REGION = {
    "AC": "Norte", "AM": "Norte", "AP": "Norte", "PA": "Norte", "RO": "Norte", "RR": "Norte",
    "TO": "Norte",
    "AL": "Nordeste", "BA": "Nordeste", "CE": "Nordeste", "MA": "Nordeste", "PB": "Nordeste",
    "PE": "Nordeste", "PI": "Nordeste", "RN": "Nordeste", "SE": "Nordeste",
    "DF": "Centro-Oeste", "GO": "Centro-Oeste", "MS": "Centro-Oeste", "MT": "Centro-Oeste",
    "ES": "Sudeste", "MG": "Sudeste", "RJ": "Sudeste", "SP": "Sudeste",
    "PR": "Sul", "RS": "Sul", "SC": "Sul",
}
UNKNOWN_REGION = "Desconhecido"

REGION_ENGLISH = {
    "Norte": "North", "Nordeste": "Northeast", "Centro-Oeste": "Central-West",
    "Sudeste": "Southeast", "Sul": "South",
}
REGION_SHORT = {"Norte": "N", "Nordeste": "NE", "Centro-Oeste": "CO", "Sudeste": "SE", "Sul": "S"}
BIG_STATES = ("SP", "RJ", "MG", "RS", "PR", "BA", "PE")

# Coordinates accepted by the geolocation staging (degrees).
LATITUDE_RANGE = (-34, 5)
LONGITUDE_RANGE = (-74, -34)

PAYMENT_TYPES = ("credit_card", "debit_card", "boleto", "voucher")

# Three-digit recency/frequency/monetary codes of each segment; a code listed under two
# segments belongs to the first one.
RFM_SEGMENT_CODES = {
    "Champions": ("555", "554", "544", "545", "454", "455", "445"),
    "Loyal Customers": ("543", "444", "435", "355", "354", "345", "344", "335"),
    "Potential Loyalists": ("553", "551", "552", "541", "542", "533", "532", "531"),
    "New Customers": ("512", "511", "422", "421", "412", "411", "311"),
    "Promising": ("525", "524", "523", "522", "521", "515", "514", "513"),
    "Need Attention": ("535", "534", "443", "434", "343", "334", "325", "324"),
    "About to Sleep": ("331", "321", "312", "221", "213", "231", "241", "251"),
    "At Risk": ("255", "254", "245", "244", "253", "252", "243", "242", "235", "234"),
    "Can't Lose Them": ("155", "154", "144", "214", "215", "115", "114", "113"),
    "Hibernating": ("332", "322", "231", "241", "335", "333", "323", "322"),
    "Lost": ("111", "112", "121", "131", "141", "151", "122", "132", "142", "152", "211", "212", "223"),
}

RFM_ACTIONS = {
    "Champions": "Reward them. They are your best customers.",
    "Loyal Customers": "Upsell higher value products. Engage them.",
    "Potential Loyalists": "Offer membership/loyalty program.",
    "New Customers": "Provide on-boarding support, build relationship.",
    "Promising": "Create brand awareness, offer free trials.",
    "Need Attention": "Make limited time offers, recommend products.",
    "About to Sleep": "Share valuable resources, recommend popular products.",
    "At Risk": "Send personalized emails, offer renewals, provide helpful resources.",
    "Can't Lose Them": "Win them back via renewals or newer products, reach out proactively.",
    "Hibernating": "Offer other products and special discounts. Recreate brand value.",
    "Lost": "Revive interest with reach out campaign, ignore otherwise.",
}
RFM_DEFAULT_ACTION = "Analyze further."

AGE_BINS = ("0-3m", "3-6m", "6-12m", "12-18m", "18-24m", "24+m")

COHORT_GROUP_TEXT = {
    "High Performers": (
        "Maintain engagement, premium loyalty programs, referrals",
        "Personalized email, App push, Ambassador program",
    ),
    "Medium Performers": (
        "Incentive campaigns, upsell, cross-sell, improved onboarding",
        "Email marketing, SMS, Push notifications",
    ),
    "Low Performers": (
        "Aggressive win-back, satisfaction survey, personalized offers, onboarding review",
        "Win-back email, Phone, NPS survey, Direct offers",
    ),
}

# strategy group -> (action, channel, budget per customer, expected ROI %, LTV target factor)
STATE_STRATEGY = {
    "Early Stage": (
        "Test marketing channels, validate product-market fit",
        "Pilot campaigns, Partnerships", 30, 15, 1.5,
    ),
    "Growth Opportunities": (
        "Targeted marketing campaigns, improve onboarding",
        "Social media, Search ads", 20, 40, 1.25,
    ),
    "Optimization Needed": (
        "Cross-sell/upsell programs, improve retention",
        "In-app messages, Retargeting", 15, 30, 1.2,
    ),
}

CLUSTER_RECOMMENDATIONS = {
    "High Value One-Time": (
        "Win-back campaigns with personalized offers",
        "Email marketing with product recommendations",
        "Special discount for second purchase",
        "Referral program incentives",
    ),
    "At Risk": (
        "Re-engagement campaigns with time-limited offers",
        "Survey to understand reasons for inactivity",
        "Personalized discounts to encourage return",
        "Retargeting ads on social media",
    ),
    # Our own actions for the two names the exports do not cover.
    "High Value Loyal": (
        "Early access to new products",
        "Tiered loyalty rewards",
        "Dedicated service contact",
        "Invitations to give product feedback",
    ),
    "Regular": (
        "Bundles that raise the order value",
        "Reminders timed to the usual purchase interval",
        "Points for every repeat purchase",
        "Cross-selling from related categories",
    ),
}
