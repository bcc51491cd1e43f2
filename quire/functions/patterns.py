"""Patterns that tell kinds of lines. Fixed values, in Java's syntax."""

# Fixed values.
PAGE_NUMBER = r"(?i)^\s*(page\s+)?\d{1,4}(\s+of\s+\d{1,4})?\s*\z"
CAPTION = r"(?i)^\s*(supplementa(?:l|ry)\s+)?(appendix\s+)?(online\s+)?(table|figure|fig|scheme|box|exhibit|chart)\b\.?\s*([0-9]{1,3}|[IVX]{1,5}|[A-Z])(?![A-Z])\s*[.:]"
METADATA_COUNT = (
    r"(?i)^\s*(abstract word count|manuscript word count|word ?count(?: of main text)?(?:\s*\([^)]{0,25}\))?|current word count|allowed word count|total word count|references|tables?|figures?|"
    r"supplemental tables?|supplementary tables?|appendices|tables?\s*/\s*figures?|number of (tables|figures|references))\s*[:=–—-]?\s*[\d,]+\s*(words?)?\s*(\([^)]{0,60}\))?\s*\z"
)
CONTACT = r"(?i)^\s*(phone|fax|tel|telephone|e-?mail(?:\s+address(?:es)?(?:\s+of\s+authors)?)?)\b"
EMAIL = r"\S+@\S+\.\S+"
ORCID = r"\b\d{4}-\d{4}-\d{4}-\d{3}[\dXx]\b"
DEGREES = (
    r"\b(MD|PhD|MPH|MSPH|MS|MSc|MSN|MA|MBA|MBBS|MBChB|RN|BSN|DrPH|ScD|ScM|DO|DDS|DMD|PharmD|DPhil|EdD|JD|BS|BA|BSc|FSA|FAAP|FACP|FRCP|CPH|MSW|MHS|MHSc|OTR|PA-C|NP|DVM|MPA|MPP)(?=\d|\b)"
)
AMBIGUOUS_DEGREES = "MA MS MD DO PA BS BA RN".split()
AFFILIATION_START = r"(?i)^\s*(from\s+the\b|from\s+<organization>|\d{1,2}\s*(?=[A-Z<])|<organization>)"
INSTITUTION = r"(?i)\b(university|department|school|institute|institution|center|centre|hospital|college|faculty|division|laboratory|clinic|foundation|ministry|agency|inc\.?|llc)\b"
CORRESPONDENCE = r"(?i)^\s*[*†‡]?\s*(address\s+correspondence|correspond(?:ing|ence)\b|address\s+reprint)"
COPYEDIT_TAG = r"(?i)<(organization|city|state|country|zip)>"
REFERENCE_ENTRY = r"^\s*\[?\d{1,3}\s*[.)\]]\s*\S"
BARE_REFERENCE = r"^\d{1,3}\s+[A-Z]"
YEAR = r"\b(19|20)\d{2}\b"
DOI_OR_URL = r"(?i)(doi|https?://|www\.)"
ABBREVIATION_LINE = r"^\s*[A-Za-z][A-Za-z0-9\-()/+]{0,14}\s*[:,]\s+\S"
CREDIT_ROLE = (
    r":.*\b(Conceptualization|Methodology|Investigation|Data [Cc]uration|Writing|Supervision|Visualization|Validation|Formal [Aa]nalysis|Funding [Aa]cquisition|"
    r"Project [Aa]dministration|Resources|Software)\b"
)
STREET = r"\b\d{2,5}\s+(?:[A-Z][A-Za-z.]*\s+){0,3}(Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Lane|Ln|Place|Pl|Box|Hwy|Suite)\b"
USA = r",\s*(USA|United States|U\.S\.A?\.?)\b"
ENUMERATED = r"^([a-z]|\d{1,2})[.)\]]{1,2}\s+\S"
PRESENT_ADDRESS = r"(?i)^\d{1,2}\s*[.)]?\s*Present address"
