"""Names of cities."""

from __future__ import annotations

# fixed values: cities as they are written today, and older or other names of them
CITY_NAMES = (
    "Bengaluru,Mumbai,Navi Mumbai,Thane,Delhi,Gurugram,Noida,Greater Noida,Ghaziabad,Faridabad,Pune,Hyderabad,Secunderabad,Chennai,Kolkata,"
    "Ahmedabad,Gandhinagar,Surat,Vadodara,Rajkot,Jaipur,Jodhpur,Udaipur,Kota,Indore,Bhopal,Gwalior,Jabalpur,Lucknow,Kanpur,Agra,Varanasi,"
    "Prayagraj,Meerut,Bareilly,Aligarh,Gorakhpur,Patna,Ranchi,Jamshedpur,Dhanbad,Bhubaneswar,Cuttack,Raipur,Nagpur,Nashik,Aurangabad,Kolhapur,"
    "Chandigarh,Mohali,Ludhiana,Amritsar,Jalandhar,Dehradun,Shimla,Jammu,Srinagar,Guwahati,Siliguri,Durgapur,Kochi,Thiruvananthapuram,Kozhikode,"
    "Thrissur,Coimbatore,Madurai,Tiruchirappalli,Salem,Mysuru,Mangaluru,Hubballi,Belagavi,Visakhapatnam,Vijayawada,Guntur,Warangal,Panaji,Puducherry"
).split(",")
CITY_ALIASES = {
    "bangalore": "Bengaluru", "bombay": "Mumbai", "new delhi": "Delhi", "gurgaon": "Gurugram", "madras": "Chennai", "calcutta": "Kolkata", "baroda": "Vadodara",
    "allahabad": "Prayagraj", "cochin": "Kochi", "trivandrum": "Thiruvananthapuram", "calicut": "Kozhikode", "trichy": "Tiruchirappalli", "mysore": "Mysuru",
    "mangalore": "Mangaluru", "hubli": "Hubballi", "belgaum": "Belagavi", "vizag": "Visakhapatnam", "pondicherry": "Puducherry",
}
CITIES = {c.lower(): c for c in CITY_NAMES} | CITY_ALIASES
