"""Patterns, word lists and tables that results depend on, as text.

Patterns are written for Python's ``re``; ``patterns.java`` rewrites them for Spark.
"""

# Statutory line categories, in order of priority.
INGREDIENTS = r'''(?:ingredients?\s*:|contains?\s*:|made\s+(?:with|from|of)\s*:|allergen|may\s+contain|alcohol\s*\(\d+%\s*v/v\)|alcohol\s*denat|denatured\s+with|denatonium\s+benzoate|added\s+(?:colour|color|flavour|flavor|preservative)|permitted\s+(?:class|food|natural)|सामग्री\s*:?|घटक\s*:?|सामग्रियां|घटकांचे\s*प्रमाण|பொருட்கள்|பொருளடக்கம்|పదార్థాలు|સામગ્રી|ઘટકો|উপাদানসমূহ|উপাদান)'''
NUTRITION = r'''(?:energy|calories|kcal|protein|(?:total\s+)?fat|carbohydrate|sodium|fibre|fiber|per\s+100\s*(?:g|ml)|per\s+serving|serving\s+size|saturated|trans\s+fat|cholesterol|total\s+sugars?|dietary|vitamins?\s+[a-z]|minerals?|calcium|iron|potassium|पोषण|ऊर्जा|प्रोटीन|कार्बोहाइड्रेट|वसा|सोडियम|कैलरी|प्रति\s*[0-9०-९]+|ஊட்டச்சத்து|புரதம்|கொழுப்பு|சக்தி|పోషకాహార(?:ం|లు)?|పోషక|ప్రోటీన్|కొవ్వు|శక్తి|પૌષ્ટિક|પ્રોટીન|ચરબી|શક્તિ|পুষ্টি|প্রোটিন|ফ্যাট|শক্তি)'''
MRP = r'''(?:(?:^|\s|\*)mrp(?:\.|\s|[:\?*]|$)|m\.r\.p\.?|maximum\s+retail\s+price|retail\s+price|₹\s*[\d०-९,]+(?:\.[\d०-९]+)?|rs\.?\s*[\d०-९,]+(?:\.[\d०-९]+)?|inr\s*[\d०-९,]+(?:\.[\d०-९]+)?|incl(?:usive)?\.?\s*(?:of)?\s*all\s*tax(?:es)?|usp(?:\s*per|\s*/|\s*:)?\s*[\d०-९,]+(?:\.[\d०-९]+)?|अधिकतम\s*(?:खुदरा|विक्रय)\s*मूल्य|अ\.खू\.मू|एम\.आर\.पी|एमआरपी|सभी\s*करों\s*सहित|कर\s*सहित|सर्व\s*करांसहित|அதிகபட்ச\s*சில்லறை\s*விலை|விலை|அ\.சி\.வி|அனைத்து\s*வரிகளும்\s*உட்பட|గరిష్ట\s*రిటైల్\s*ధర|ధర|అన్ని\s*పన్నులతో\s*సహా|મહત્તમ\s*છૂટક\s*કિંમત|કિંમત|તમામ\s*કર\s*સહિત|সর্বোচ্চ\s*খুচরা\s*মূল্য|মূল্য|সকল\s*কর\s*সহ|\bR\s+\d{1,5}(?:\.\d{1,2})?\b|\b2\s+\d{1,5}(?:\.\d{1,2})?\b|\bF\s+\d{1,5}(?:\.\d{1,2})?\b|\b[Rr][Ss]\s*\.?\s*\d{1,5}\b|[?\uFF1A]\s*\d{1,5}\s*(?:/-)?|\b\d{1,5}(?:\.\d{1,2})?\s*/-(?:\s|$))'''
QUANTITY = r'''(?:net\s*(?:wt|weight|vol|volume|qty|quantity|contents?)|\b[\d०-९]+(?:\.[\d०-९]+)?\s*(?:grams?|kilograms?|millilit(?:re|er)s?|lit(?:re|er)s?)\b|\b[\d०-९]+(?:\.[\d०-९]+)?\s*(?:gm|gms|kgs?|mls?|ltrs?|lts?|fl\.?\s*oz\.?)\b|\b[\d०-९]+(?:\.[\d०-९]+)?\s*(?:kg|g|l|ml)\b|\b[\d०-९]+(?:\.[\d०-९]+)?\s*ml\s*/\s*[\d०-९]+(?:\.[\d०-९]+)?\s*g\b|\bnet\s+[\d०-९]|शुद्ध\s*(?:मात्रा|वजन|तोल)|निव्वळ\s*वजन|निकासी\s*मात्रा|நிகர\s*(?:எடை|அளவு)|அளவு|నికర\s*(?:పరిమాణం|బరువు)|పరిమాణం|ચોખ્ખું\s*વજન|વજન|মোট\s*ওজন|পরিমাণ|[\d०-९]+\s*(?:ग्राम|किलोग्राम|मिली|लीटर|मि\.ली|ली\.|ഗ്രാം|கிலோ|கிராம்|మిల్లీ|లీటర్))'''
MFG_DATE = r'''(?:mfg\.?\s*(?:date|dt|on)\b|mfg\s*[:\-]|date\s+of\s+(?:mfg|manufacture|manufacturing|packing|mfr)|pkd\.?\s*(?:date|dt|on)\b|pkd\s*[:\-]|packing\s+date|packed\s+on|best\s+before|use\s+(?:by|before)|expir(?:y|es?|ation)\s*(?:date)?|bb\s*:|\b[\d०-९]{1,2}[/\.\-][\d०-९]{1,2}[/\.\-][\d०-९]{2,4}\b|\b(?:0[1-9]|1[0-2]|०[१-९]|१[०-२])[/\.\-](?:20\d{2}|\d{2}|२०[०-९]{2})\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s\-][\d०-९]{2,4}\b|निर्माण\s*(?:की\s*)?(?:तिथि|दिनांक)|उत्पादन\s*दिनांक|पैकिंग\s*(?:की\s*)?(?:तिथि|दिनांक)|पैक्ड|उपयोग\s*की\s*अंतिम\s*तिथि|समाप्ति\s*तिथि|सर्वोत्तम\s*उपयोग|தயாரிப்பு\s*தேதி|உபயோகிக்கும்\s*காலம்|காலாவதி\s*தேதி|తయారీ\s*తేదీ|ఉత్పత్తి\s*తేదీ|గడువు\s*తేదీ|ઉત્પાદન\s*તારીખ|વાપરવાની\s*છેલ્લી\s*તારીખ|তৈরির\s*তারিখ|মেয়াদ\s*উত্তীর্ণের\s*তারিখ)'''
BATCH_NUMBER = r'''(?:batch\s*(?:no|code|num)?\.?\s*:?|b\.?\s*no\.?\s*:?|\blot\s*(?:no|num)?\.?\s*:?|बैच\s*(?:संख्या|सं|कोड|नं)?\.?\s*:?|தொகுதி\s*எண்|బ్యాచ్\s*(?:నంబర్|సంఖ్య)|જથ્થા\s*નંબર|ব্যাচ\s*নং)'''
LICENSE = r'''(?:fssai|food\s+safety|f\.s\.s\.a\.i|lic(?:ense|ence|\.)\s*(?:no|num|number)?\.?\s*:?|m\.?l\.?\s*no\.?|mfg\.?\s*lic\.?\s*no\.?|mfglic\.?\s*no\.?|permit\s+no\.?|st\.?\s*ex\.?\s*lic\.?\s*no\.?|lic\s*no\.?|cm[/\\]l\s*no|\bbis\b|\bbis\s*lic|\bbis\s*cert|isi\s+mark|agmark|iso\s*\d{4,5}|एफएसएसएआई|खाद्य\s*सुरक्षा|लाइसेंस\s*(?:सं|संख्या|नं)?\.?\s*:?|परवाना\s*(?:क्रमांक|क्र|नं)?\.?\s*:?|உரிம\s*எண்|లైసెన్స్\s*సంఖ్య|પરવાના\s*નંબર|লাইসেন্স\s*নং)'''
HELPLINE = r'''(?:consumer\s*(?:care|helpline|services?|affairs?|complaints?)|customer\s*(?:care|service|support)|helpline|toll[\s\-]*free|grievance|feedback\s*(?:no|number|num)?|1[\s\-]*800[\s\-]*\d{3,4}[\s\-]*\d{3,5}|1800\d{6,9}|\+?91[\s\-]*[6-9]\d{9}|[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,6}|www\.[a-z0-9\-]+\.[a-z]{2,}|ग्राहक\s*(?:सेवा|सहायता|देखभाल)|उपभोक्ता\s*(?:सेवा|मामले|हेल्पलाइन)|हेल्पलाइन|शिकायत\s*(?:निवारण|दर्ज)|टोल\s*फ्री|வாடிக்கையாளர்\s*சேவை|వినియోగదారుల\s*సేవ|హెల్ప్‌లైన్|ગ્રાહક\s*સેવા|હેલ્પલાઇન|গ্রাহক\s*সেবা|হেল্পলাইন)'''
ADDRESS = r'''(?:mfg\.?\s+by|manufactured\s+by|marketed\s+by|packed\s+by|imported\s+by|distributed\s+by|pvt\.?\s*ltd\.?|private\s+limited|limited|llp\b|ltd\b|plot\s*(?:no|num)?\.?\s*\d|(?:phase|sector|block)\s*[a-z]?\s*[\d\-]|\b[1-9]\d{5}\b|industrial\s+(?:area|estate|zone|plot)|ind\.\s*area|midc|gidc|hsiidc|upsidc|\bnagar\b|\bmarg\b|\bcolony\b|\blayout\b|\broad\b|\brd\b|\bhighway\b|\bexpressway\b|dist(?:rict)?\.?\s*(?:\w+)|tehsil\b|village\b|(?:mumbai|delhi|bengaluru|bangalore|hyderabad|chennai|kolkata|pune|ahmedabad|surat|jaipur|lucknow|kanpur|nagpur|coimbatore|indore|thane|bhopal|visakhapatnam|vadodara|agra|ludhiana|nashik|faridabad|meerut|rajkot|varanasi|aurangabad|amritsar|ranchi|guwahati|chandigarh|dehradun|noida|gurugram|gurgaon|alwar|neemrana|rajpura|ropar|hamirpur|sumerpur|vikhroli|khandsa)\b|(?:gujarat|maharashtra|rajasthan|haryana|punjab|uttar\s+pradesh|karnataka|tamil\s+nadu|andhra\s+pradesh|telangana|kerala|odisha|jharkhand|west\s+bengal|madhya\s+pradesh|bihar|assam|himachal|uttarakhand)\b|india\s*[-–\s]*\d{6}|made\s*in\s*india|registered\s+address|regd\.\s*office|godrej|unilever|hindustan\s+unilever|idam|stella|helios|aroma\s+de\s+france|निर्माता|उत्पादक|पैकर|द्वारा\s*निर्मित|मार्केटेड\s*बाय|द्वारा\s*पैक|पंजीकृत\s*(?:कार्यालय|पता)|भारत\s*में\s*निर्मित|उत्पत्ति\s*का\s*देश|தயாரிப்பாளர்|விற்பனையாளர்|உற்பத்தியாளர்|தயாரிப்பு\s*நாடு|తయారీదారు|విక్రేత|ఉత్పత్తిదారు|ઉત્પાદક|વેચાણકર્તા|ઉત્પાદન\s*દેશ|প্রস্তুতকারক|কোম্পানি|উৎপাদনকারী)'''
MISSPELLED = r'''(?:net\s+weigt|best\s+befor|max\s+retale\s+price|inclusiv\s+of|maufactured|manufacured|fssi\b|packd|ingredints)'''
COMMODITY = r'''\b(?:b?iscuits?|riscuits?|cookies?|rusk|namkeen|chips|wafers?|bread|cakes?|juice|chai|tea|coffee|oil|atta|flour|sugar|salt|spices|masala|noodles|snack|snacks|confectionery|candy|toffee|balls|p?remiums?|remiums?|classic|select|gold|special|family\s*pack)\b'''
GARBLED = r'''^(?:RRTO|RRE|TT|IIL|O00|I1l|HHL|ZRR|W0|LL|NN|SS|ER|TET|V1|FF|CC|PP|BB|DD|KK|MM|YY|ZZ|[B-DF-HJ-NP-TV-Z]{2,4})$'''
MARATHI_SUFFIX = r'''[\u0900-\u097F]{2,}(?:च्या|ची|चे|चा|तील|साठी|मध्ये|वरून|कडून|करांसहित)\b'''
HINDI_POSTPOSITION = r'''\b(?:का|के|की|में|से|पर|द्वारा|लिए|है|हैं|था|थी|थे)\b'''

# What a declaration must hold to satisfy its rule.
MRP_VALUE = r'''(?:mrp|m\.r\.p|maximum\s+retail\s+price|₹|rs\.?|inr|अ\.खू\.मू|अधिकतम\s*(?:खुदरा|विक्रय)\s*मूल्य|एम\.आर\.पी|एमआरपी|விலை|அ\.சி\.வி|ధర|કિંમત|মূল্য)\s*[:\?*]?\s*[\d०-९,]+(?:\.[\d०-९]+)?|[\d०-९,]+(?:\.[\d०-९]+)?\s*(?:₹|rs\.?|/-|रुपये|ரூபாய்)|[:\?\uFF1A]\s*[\d०-९]{1,5}(?:\.[\d०-९]{1,2})?\s*(?:/-)?|\b[\d०-९]{1,5}(?:\.[\d०-९]{1,2})?\s*/-\b|\b[\d०-९]{1,5}\.[\d०-९]{2}\b|\bR\s+[\d०-९]{1,5}(?:\.[\d०-९]{1,2})?\b|\b2\s+[\d०-९]{1,5}(?:\.[\d०-९]{1,2})?\b|mrp\s*[:\?*]?\s*[\d०-९]+|\b^[\d०-९]{1,4}(?:\.[\d०-९]{1,2})?$'''
INCLUSIVE = r'''incl(?:usive)?\.?\s*(?:of)?\s*all\s*tax(?:es)?|incl\.\s*tax|inclusive\s*tax|incl\.of\s*all\s*taxes|inclusive\s*of\s*all\s*taxes|incl\.\s*of\s*all\s*taxes|inclofalltaxes|incl\.ofall\s*taxes|सभी\s*करों\s*सहित|कर\s*सहित|करांसहित|அனைத்து\s*வரிகளும்\s*உட்பட|అన్ని\s*పన్నులతో\s*సహా|તમામ\s*કર\s*સહિત|সকল\s*কর\s*সহ'''
SI_UNIT = r'''\b[\d०-९]+(?:\.[\d०-९]+)?\s*(?:grams?|kilograms?|millilitr(?:e|er)s?|litr(?:e|er)s?|gm|gms|kgs?|mls?|ltrs?|units?|kg|g|l|ml|fl\.?\s*oz)\b|\b[\d०-९]+(?:\.[\d०-९]+)?\s*ml\s*/\s*[\d०-९]+(?:\.[\d०-९]+)?\s*g\b|[\d०-९]+\s*(?:ग्राम|किलोग्राम|मिली|लीटर|मि\.ली|ली\.|ഗ്രാം|கிலோ|கிராம்|మిల్లీ|లీటర్|ગ્રામ|કિલો)'''
DATE_VALUE = r'''\b[\d०-९]{1,2}[/.\-][\d०-९]{1,2}[/.\-][\d०-९]{2,4}\b|\b(?:0[1-9]|1[0-2]|०[१-९]|१[०-२])[/\.\-](?:20\d{2}|\d{2}|२०[\d०-९]{2})\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s\-][\d०-९]{2,4}\b|\b[\d०-९]{1,2}[/.\-][\d०-९]{2,4}\b|\b[\d०-९]{1,2}\s+(?:months|days|years|महीने|माह|दिवस)\s+(?:from|after|के\s*भीतर|बाद)\b|(?:mfd|mfg|pkd|packed|pkg)\.?\s*(?:see|check|read)?\s*(?:coding|stamp|crimp|seal|top|panel|below)|निर्माण\s*(?:की\s*)?(?:तिथि|दिनांक)|उत्पादन\s*दिनांक|पैकिंग\s*(?:की\s*)?(?:तिथि|दिनांक)|उपयोग\s*की\s*अंतिम\s*तिथि|समाप्ति\s*तिथि|தயாரிப்பு\s*தேதி|உபயோகிக்கும்\s*காலம்|తయారీ\s*తేదీ|ఉత్పత్తి\s*తేదీ|ઉત્પાદન\s*તારીખ|তৈরির\s*তারিখ'''
LICENSE_VALUE = r'''\b(?:1[0-9]{13}|fssai|lic(?:\.|\s*no)?\s*[:\-\.]?\s*[0-9]{5,14}|m\.?l\.?\s*no\.?|mfg\.?\s*lic\.?\s*no\.?|mfglic\.?\s*no\.?|permit\s+no\.?|st\.?\s*ex\.?\s*lic\.?\s*no\.?|lic\s*no\.?|cm[/\\]l\s*no|bis|isi\s+mark|agmark|iso\s*\d{4,5}|एफएसएसएआई|खाद्य\s*सुरक्षा|लाइसेंस\s*(?:सं|संख्या|नं)|உரிம\s*எண்|లైసెన్స్\s*సంఖ్య|લાઇસન્સ)\b'''
HELPLINE_VALUE = r'''(?:1[-\s]?800[-\s]?[0-9]{2,4}[-\s]?[0-9]{2,4}[-\s]?[0-9]{2,5}|1800\d{6,9}|\+?91[-\s]?[6-9][0-9]{9}|[\w\.-]+@[\w\.-]+\.\w{2,6}|lever\s*care|consumer\s*care|customer\s*care|ग्राहक\s*(?:सेवा|सहायता)|उपभोक्ता\s*(?:सेवा|मामले)|हेल्पलाइन|शिकायत\s*(?:निवारण|दर्ज)|வாடிக்கையாளர்\s*சேவை|వినియోగదారుల\s*సేవ|ગ્રાહક\s*સેવા|www\.[\w\.-]+\.\w{2,})'''

# State codes of food licences.
STATES = {'00': 'Central Licensing Authority / All India (FSSAI HQ)',
 '01': 'Jammu & Kashmir',
 '02': 'Himachal Pradesh',
 '03': 'Punjab',
 '04': 'Chandigarh',
 '05': 'Uttarakhand',
 '06': 'Haryana',
 '07': 'Delhi',
 '08': 'Rajasthan',
 '09': 'Uttar Pradesh',
 '10': 'Bihar',
 '11': 'Sikkim',
 '12': 'Arunachal Pradesh',
 '13': 'Nagaland',
 '14': 'Manipur',
 '15': 'Mizoram',
 '16': 'Tripura',
 '17': 'Meghalaya',
 '18': 'Assam',
 '19': 'West Bengal',
 '20': 'Jharkhand',
 '21': 'Odisha',
 '22': 'Chhattisgarh',
 '23': 'Madhya Pradesh',
 '24': 'Gujarat',
 '25': 'Daman & Diu',
 '26': 'Dadra & Nagar Haveli',
 '27': 'Maharashtra',
 '28': 'Andhra Pradesh (Legacy)',
 '29': 'Karnataka',
 '30': 'Goa',
 '31': 'Lakshadweep',
 '32': 'Kerala',
 '33': 'Tamil Nadu',
 '34': 'Puducherry',
 '35': 'Andaman & Nicobar Islands',
 '36': 'Telangana',
 '37': 'Andhra Pradesh'}

# State letters of corporate numbers.
STATE_LETTERS = ('JK', 'HP', 'PB', 'CH', 'UT', 'UR', 'HR', 'DL', 'RJ', 'UP', 'BR', 'SK', 'AR', 'NL', 'MN', 'MZ', 'TR', 'ML', 'AS', 'WB', 'JH', 'OR', 'OD', 'CT', 'CG',
 'MP', 'GJ', 'DD', 'DN', 'MH', 'KA', 'GA', 'LD', 'KL', 'TN', 'PY', 'AN', 'TG', 'TS', 'AP')

# First digit of food licences.
LICENSE_KINDS = {'1': 'Central License (Large Scale / Importer / EOU / High Turnover >20Cr)',
 '2': 'State License (Medium Scale Manufacturer / Wholesaler / Distributor)',
 '3': 'Basic Registration (Petty Food Business / Small Scale Retailer)'}

# Entity letters of corporate numbers.
ENTITIES = {'PLC': 'Public Limited Company',
 'PTC': 'Private Limited Company',
 'FTC': 'Subsidiary of a Foreign Company',
 'GOI': 'Union Government Company',
 'SGC': 'State Government Company',
 'GAP': 'General Association Public',
 'GAT': 'General Association Private',
 'NPL': 'Not For Profit / Section 8 License Company',
 'ULL': 'Public Unlimited Liability Company',
 'ULT': 'Private Unlimited Liability Company'}

# Barcode prefixes.
GS1_COUNTRIES = {'890': 'GS1 India (National Legal Metrology Compliant)',
 '000': 'GS1 US / North America',
 '001': 'GS1 US / North America',
 '002': 'GS1 US / North America',
 '003': 'GS1 US / North America',
 '004': 'GS1 US / North America',
 '005': 'GS1 US / North America',
 '006': 'GS1 US / North America',
 '007': 'GS1 US / North America',
 '008': 'GS1 US / North America',
 '009': 'GS1 US / North America',
 '500': 'GS1 UK',
 '501': 'GS1 UK',
 '502': 'GS1 UK',
 '503': 'GS1 UK',
 '504': 'GS1 UK',
 '505': 'GS1 UK',
 '506': 'GS1 UK',
 '509': 'GS1 UK',
 '400': 'GS1 Germany',
 '690': 'GS1 China',
 '691': 'GS1 China',
 '692': 'GS1 China',
 '693': 'GS1 China',
 '694': 'GS1 China',
 '695': 'GS1 China'}

# Characters that look alike.
HOMOGLYPHS = {'0': 'o',
 '1': 'l',
 '2': 'z',
 '3': 'e',
 '4': 'a',
 '5': 's',
 '6': 'b',
 '7': 't',
 '8': 'b',
 '9': 'g',
 '@': 'a',
 '$': 's',
 '!': 'i',
 '|': 'l',
 '+': 't',
 '¢': 'c',
 '£': 'e',
 '¥': 'y'}

# Groups that look alike, replaced in this order.
HOMOGLYPH_PAIRS = [('rn', 'm'), ('vv', 'w'), ('cl', 'd'), ('nn', 'm'), ('ij', 'y'), ('iv', 'w'), ('l1', 'll'), ('1l', 'll'), ('nu', 'mu'), ('an', 'am')]

# Groups that sound alike, replaced in this order.
DIGRAPHS = [('ph', 'f'), ('bh', 'b'), ('kh', 'k'), ('th', 't'), ('dh', 'd'), ('gh', 'g'), ('sh', 's'), ('zh', 's'), ('ee', 'i'), ('oo', 'u'), ('ou', 'u'),
 ('au', 'o'), ('ai', 'e'), ('ea', 'e'), ('ie', 'i'), ('w', 'v'), ('y', 'i'), ('z', 's')]

# Words that name no brand.
GENERIC = ('oil', 'soap', 'synthetic', 'glue', 'paracetamol', 'biscuits', 'biscuit', 'butter', 'classic', 'gold', 'tablets', 'tablet', 'syrup', 'drops',
 'powder', 'cream', 'milk', 'pure', 'natural', 'fresh', 'provisions', 'corner', 'store', 'foods', 'products', 'industries', 'ltd', 'limited', 'pvt',
 'private', 'chai', 'tea', 'salt', 'atta', 'ghee', 'water', 'shampoo', 'paste', 'detergent', 'packaged', 'drinking', 'drink', 'mineral', 'bottle',
 'bottled', 'wae', 'drinsing', 'pack', 'family', 'special', 'premium', 'select')

# Short words that are not garble.
ACRONYMS = ('mrp', 'mfg', 'pkd', 'exp', 'lic', 'fssai', 'veg', 'non', 'no', 'rs', 'wt', 'qty', 'gm', 'gms', 'kg', 'kgs', 'ml', 'mls', 'ltr', 'lt', 'cm', 'mm',
 'bb', 'd', 'g', 'l', 'b', 'usp', 'inr', 'net', 'max', 'vol', 'jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec',
 'iso', 'bis', 'isi', 'cin', 'gstin', 'fmcg', 'llp', 'ltd', 'pvt', 'care', 'tel', 'fax', 'regd', 'midc', 'gidc', 'pack', 'brand', 'plus', 'super',
 'pure', 'rich', 'gold', 'real', 'special', 'bhel', 'family')

# Marathi words.
MARATHI = ('पुलाची', 'प्रसिद्ध', 'भेळ', 'करांसहित', 'निव्वळ', 'उत्पादक', 'दिनांक', 'जिभेला', 'चव', 'येणारी', 'माणसं', 'स्पेशल', 'वापरा', 'घटकांचे', 'पत्ता',
 'संपर्क', 'आशा', 'चिवडा', 'लाडू', 'चकली', 'मसाले', 'शेव', 'लोणचे', 'पापड', 'आंबटगोड', 'कुरकुरीत', 'स्वादिष्ट', 'उत्कृष्ट', 'खाद्यपदार्थ', 'विक्रेता',
 'ग्राहक', 'सेवा', 'महाराष्ट्र', 'पुणे', 'मुंबई', 'कोल्हापूर', 'सोलापूर', 'नाशिक', 'नागपूर', 'सातारा', 'सांगली')

# Hindi phrases.
HINDI = ('सभी करों सहित', 'शुद्ध मात्रा', 'शुद्ध वजन', 'निकासी मात्रा', 'निर्माण तिथि', 'उत्पादन दिनांक', 'पैकिंग तिथि', 'उपयोग की अंतिम तिथि',
 'समाप्ति तिथि', 'सामग्री', 'सामग्रियां', 'घटक द्रव्य', 'उपभोक्ता सेवा', 'उपभोक्ता मामले', 'हेल्पलाइन', 'शिकायत निवारण', 'टोल फ्री', 'निर्माता',
 'दुकानदार', 'पंजीकृत कार्यालय', 'उत्पत्ति का देश', 'भारत में निर्मित', 'बैच संख्या', 'एमआरपी', 'अधिकतम खुदरा मूल्य', 'अ.खू.मू', 'उत्तर प्रदेश',
 'मध्य प्रदेश', 'राजस्थान', 'बिहार', 'हरियाणा', 'उत्तराखंड', 'दिल्ली', 'अलवर', 'हरिद्वार')

# Spellings of statutory entities.
ALIASES = {'mrp': ['mrp', 'm.r.p', 'maximum retail price', 'max retail price', 'incl. of all taxes', 'inclusive of all taxes', 'incl of taxes', 'price',
         'अधिकतम खुदरा मूल्य', 'अ.खू.मू', 'एम.आर.पी', 'एमआरपी', 'कर सहित', 'सभी करों सहित', 'அதிகபட்ச சில்லறை விலை', 'விலை', 'அ.சி.வி',
         'அனைத்து வரிகளும் உட்பட', 'గరిష్ట రిటైల్ ధర', 'ధర', 'అన్ని పన్నులతో సహా', 'મહત્તમ છૂટક કિંમત', 'કિંમત', 'તમામ કર સહિત',
         'সর্বোচ্চ খুচরা মূল্য', 'মূল্য', 'সকল কর সহ'],
 'net_qty': ['net weight', 'net wt', 'net quantity', 'net qty', 'net volume', 'net contents', 'weight', 'volume', 'quantity', 'contents',
             'शुद्ध मात्रा', 'शुद्ध वजन', 'निव्वळ वजन', 'मात्रा', 'वजन', 'நிகர எடை', 'நிகர அளவு', 'அளவு', 'నికర పరిమాణం', 'నికర బరువు', 'పరిమాణం',
             'ચોખ્ખું વજન', 'વજન', 'মোট ওজন', 'পরিমাণ'],
 'mfg_date': ['mfg date', 'mfg', 'pkd', 'pkd on', 'packed on', 'date of mfg', 'date of manufacture', 'manufacturing date', 'manufactured on',
              'निर्माण तिथि', 'उत्पादन दिनांक', 'पैकिंग तिथि', 'पैक्ड', 'தயாரிப்பு தேதி', 'உற்பத்தி தேதி', 'తయారీ తేదీ', 'ఉత్పత్తి తేదీ',
              'ઉત્પાદન તારીખ', 'તૈયાર કર્યા તારીખ', 'তৈরির তারিখ'],
 'expiry_date': ['best before', 'expiry date', 'exp date', 'use by', 'expiry', 'use before', 'best before date', 'exp', 'उपयोग की अंतिम तिथि',
                 'समाप्ति तिथि', 'सर्वोत्तम उपयोग', 'உபயோகிக்கும் காலம்', 'காலாவதி தேதி', 'గడువు తేదీ', 'વાપરવાની છેલ્લી તારીખ',
                 'মেয়াদ উত্তীর্ণের তারিখ'],
 'manufacturer': ['mfd by', 'manufactured by', 'packed by', 'pkd by', 'marketed by', 'mktd by', 'imported by', 'consumer care', 'customer care',
                  'निर्माता', 'उत्पादक', 'पैकर', 'द्वारा निर्मित', 'पंजीकृत कार्यालय', 'தயாரிப்பாளர்', 'விற்பனையாளர்', 'உற்பத்தியாளர்', 'తయారీదారు',
                  'విక్రేత', 'ઉત્પાદક', 'વેચાણકર્તા', 'প্রস্তুতকারক', 'কোম্পানি'],
 'country_of_origin': ['country of origin', 'made in', 'origin', 'produced in', 'manufactured in', 'उत्पत्ति का देश', 'भारत में निर्मित', 'स्वदेशी',
                       'தயாரிப்பு நாடு', 'ఉత్పత్తి దేశం', 'ઉત્પાદન દેશ']}

# Words that mark a text as a declaration, not a brand, and the categories of declarations.
DECLARATION = r"\b(?:mrp|rs|₹|batch|pkg|mfg|pkd|exp|expiry|net\s*wt|net\s*qty|fssai|lic(?:\.|\s*no)?|email|phone|tel|fax|gram|kg|g|ml|l|tax|taxes|servings?|nutrition|ingredients|dosage|instructions|warning|caution|best\s*before|use\s*by)\b"
STATUTORY = ("mrp", "quantity", "mfg_date", "license", "address", "helpline", "nutrition", "ingredients", "batch_number")

# Keywords of a line that give the next one its category, and the form that it must have.
CONTEXT = [
    ("quantity", ("net content", "net wt", "net qty", "net volume", "शुद्ध मात्रा", "शुद्ध वजन", "निव्वळ वजन", "நிகர எடை", "పరిమాణం"), r"\b[\d०-९]+(?:\.[\d०-९]+)?\s*(?:ml|g|gm|kg|l|fl\.?\s*oz|ग्राम|मिली|लीटर)\b"),
    ("mrp", ("mrp", "price", "m.r.p", "अ.खू.मू", "अधिकतम खुदरा मूल्य", "एमआरपी", "விலை", "ధర", "કિંમત", "মূল্য"), r"\b[\d०-९]{1,5}(?:\.[\d०-९]{1,2})?\b"),
    ("mfg_date", ("mfg", "pkd", "packed", "best before", "use before", "use by", "exp", "निर्माण तिथि", "उत्पादन दिनांक", "पैकिंग तिथि", "उपयोग की अंतिम तिथि", "தயாரிப்பு தேதி", "తయారీ తేదీ"), r"\b[\d०-९]{1,2}[/\.\-][\d०-९]{2,4}\b|\b[\d०-९]{1,2}\s+(?:months|days|महीने|माह)\b"),
    ("batch_number", ("batch", "lot", "b.no", "b. no", "बैच", "लॉट", "தொகுதி"), None),
    ("address", ("marketed by", "manufactured by", "mfg by", "packed by", "registered address", "regd office", "निर्माता", "उत्पादक", "द्वारा निर्मित", "पंजीकृत", "தயாரிப்பாளர்", "తయారీదారు"), None),
]

# Patterns of places, net contents and ingredients in the rules.
PLACE = "\\b[1-9]\\d{5}\\b|pvt|ltd|mfg|road|nagar|dist|delhi|mumbai|gurugram|punjab|gujarat|haryana|rajasthan|india|godrej|unilever|idam|stella|helios|निर्माता|उत्पादक|पैकर|लिमिटेड|कार्यालय|पता|मार्केटेड|தயாரிப்பாளர்|விற்பனையாளர்|ఉత్పత్తి|உற்பத்தியாளர்"
NET = r"\b(?:net\s*(?:wt|qty|vol|weight|contents?)|volume|content)\b"
CONTENTS = "ingredient|contain|alcohol|aqua|parfum|fragrance"

# Words of company names that do not point to a company.
CORPORATE = ("ltd", "limited", "pvt", "private", "india", "foods", "industries", "products")
