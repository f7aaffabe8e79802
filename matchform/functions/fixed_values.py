"""Values that have to equal the published ones for results to match."""

# Hand-kept team names and their codes, in their published order.
CURATED_TEAM_CODES = (
    ("Ajaccio", "AJA"),
    ("Alaves", "ALA"),
    ("Almeria", "ALM"),
    ("Amiens", "AMI"),
    ("Angers", "ANG"),
    ("Arminia Bielefeld", "ARM"),
    ("Bielefeld", "ARM"),
    ("Arsenal", "ARS"),
    ("Atalanta", "ATA"),
    ("Athletic Club", "ATH"),
    ("Ath Bilbao", "ATH"),
    ("Atletico Madrid", "ATL"),
    ("Ath Madrid", "ATL"),
    ("Augsburg", "AUG"),
    ("Auxerre", "AUX"),
    ("Aston Villa", "AVL"),
    ("Barcelona", "BAR"),
    ("Bayern Munich", "BAY"),
    ("Benevento", "BEN"),
    ("Real Betis", "BET"),
    ("Betis", "BET"),
    ("Borussia M.Gladbach", "BMG"),
    ("M'gladbach", "BMG"),
    ("Bochum", "BOC"),
    ("Bologna", "BOL"),
    ("Bordeaux", "BOR"),
    ("Bournemouth", "BOU"),
    ("Brentford", "BRE"),
    ("Brest", "BRE"),
    ("Brighton", "BRI"),
    ("Brescia", "BSC"),
    ("Burnley", "BUR"),
    ("Cadiz", "CAD"),
    ("Cagliari", "CAG"),
    ("Celta Vigo", "CEL"),
    ("Celta", "CEL"),
    ("Chelsea", "CHE"),
    ("Clermont Foot", "CLE"),
    ("Clermont", "CLE"),
    ("FC Cologne", "COL"),
    ("FC Koln", "COL"),
    ("Como", "COM"),
    ("Coventry", "COV"),
    ("Cremonese", "CRE"),
    ("Crotone", "CRO"),
    ("Crystal Palace", "CRY"),
    ("Darmstadt", "DAR"),
    ("Deportivo La Coruna", "DEP"),
    ("La Coruna", "DEP"),
    ("Dijon", "DJN"),
    ("Borussia Dortmund", "DOR"),
    ("Dortmund", "DOR"),
    ("Eibar", "EIB"),
    ("Eintracht Frankfurt", "EIN"),
    ("Ein Frankfurt", "EIN"),
    ("Elche", "ELC"),
    ("Elversberg", "ELV"),
    ("Empoli", "EMP"),
    ("Espanyol", "ESP"),
    ("Espanol", "ESP"),
    ("Everton", "EVE"),
    ("Fiorentina", "FIO"),
    ("Fulham", "FLH"),
    ("Fortuna Duesseldorf", "FOR"),
    ("Fortuna Dusseldorf", "FOR"),
    ("Freiburg", "FRE"),
    ("Frosinone", "FRO"),
    ("Genoa", "GEN"),
    ("Getafe", "GET"),
    ("Girona", "GIR"),
    ("Granada", "GRA"),
    ("Greuther Fuerth", "GRE"),
    ("Greuther Furth", "GRE"),
    ("Hamburger SV", "HAM"),
    ("Hamburg", "HAM"),
    ("FC Heidenheim", "HEI"),
    ("Heidenheim", "HEI"),
    ("Hertha Berlin", "HER"),
    ("Hertha", "HER"),
    ("Hoffenheim", "HOF"),
    ("SD Huesca", "HUE"),
    ("Huesca", "HUE"),
    ("Hull", "HUL"),
    ("Inter", "INT"),
    ("Ipswich", "IPS"),
    ("Juventus", "JUV"),
    ("Holstein Kiel", "KIE"),
    ("Kiel", "KIE"),
    ("Lazio", "LAZ"),
    ("Lecce", "LEC"),
    ("Leeds", "LED"),
    ("Leganes", "LEG"),
    ("Leicester", "LEI"),
    ("Le Mans", "LEM"),
    ("Lens", "LEN"),
    ("Bayer Leverkusen", "LEV"),
    ("Leverkusen", "LEV"),
    ("Levante", "LEV"),
    ("Le Havre", "LHV"),
    ("Lille", "LIL"),
    ("Liverpool", "LIV"),
    ("Lorient", "LOR"),
    ("Las Palmas", "LPL"),
    ("Luton", "LUT"),
    ("Lyon", "LYO"),
    ("Mainz 05", "MAI"),
    ("Mainz", "MAI"),
    ("Malaga", "MAL"),
    ("Mallorca", "MAL"),
    ("Marseille", "MAR"),
    ("Metz", "MET"),
    ("AC Milan", "MIL"),
    ("Milan", "MIL"),
    ("Monaco", "MON"),
    ("Monza", "MON"),
    ("Montpellier", "MPL"),
    ("Manchester City", "MCI"),
    ("Man City", "MCI"),
    ("Manchester United", "MUN"),
    ("Man United", "MUN"),
    ("Nantes", "NAN"),
    ("Napoli", "NAP"),
    ("Newcastle United", "NEW"),
    ("Newcastle", "NEW"),
    ("Nice", "NIC"),
    ("Nimes", "NIM"),
    ("Norwich", "NOR"),
    ("Nottingham Forest", "NOT"),
    ("Nott'm Forest", "NOT"),
    ("Osasuna", "OSA"),
    ("Real Oviedo", "OVI"),
    ("Oviedo", "OVI"),
    ("Paderborn", "PAD"),
    ("Paris FC", "PAR"),
    ("Paris Saint Germain", "PSG"),
    ("Paris SG", "PSG"),
    ("Pisa", "PIS"),
    ("Racing Santander", "RAS"),
    ("Santander", "RAS"),
    ("RasenBallsport Leipzig", "RBL"),
    ("RB Leipzig", "RBL"),
    ("Reims", "REI"),
    ("Rennes", "REN"),
    ("Real Madrid", "RMA"),
    ("Roma", "ROM"),
    ("Rayo Vallecano", "RVL"),
    ("Vallecano", "RVL"),
    ("Salernitana", "SAL"),
    ("Sampdoria", "SAM"),
    ("Sassuolo", "SAS"),
    ("Schalke 04", "SCH"),
    ("Saint-Etienne", "SEN"),
    ("St Etienne", "SEN"),
    ("Sevilla", "SEV"),
    ("Sheffield United", "SHE"),
    ("Real Sociedad", "SOC"),
    ("Sociedad", "SOC"),
    ("Southampton", "SOU"),
    ("St. Pauli", "SPA"),
    ("St Pauli", "SPA"),
    ("Spezia", "SPE"),
    ("SPAL 2013", "SPL"),
    ("Spal", "SPL"),
    ("Strasbourg", "STR"),
    ("VfB Stuttgart", "STU"),
    ("Stuttgart", "STU"),
    ("Sunderland", "SUN"),
    ("Torino", "TOR"),
    ("Tottenham", "TOT"),
    ("Toulouse", "TOU"),
    ("Troyes", "TRO"),
    ("Udinese", "UDI"),
    ("Union Berlin", "UNI"),
    ("Real Valladolid", "VAL"),
    ("Valladolid", "VAL"),
    ("Venezia", "VEN"),
    ("Verona", "VER"),
    ("Villarreal", "VIL"),
    ("Watford", "WAT"),
    ("West Bromwich Albion", "WBA"),
    ("West Brom", "WBA"),
    ("Werder Bremen", "WER"),
    ("West Ham", "WHU"),
    ("Wolfsburg", "WOB"),
    ("Wolverhampton Wanderers", "WOL"),
    ("Wolves", "WOL"),
)

# League code to the folder and file prefix of its xG files.
XG_PREFIXES = {
    "E0": "eng",
    "SP1": "esp",
    "I1": "ita",
    "D1": "ger",
    "F1": "fra",
}
