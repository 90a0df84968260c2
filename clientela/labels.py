"""Channel names, segment names, texts and display headers that results must carry."""

# ---- channels ---------------------------------------------------------------------------------
IFOOD = "iFood"
FOOD99 = "99food"
STORE = "Loja"
CHANNELS = (IFOOD, FOOD99, STORE)

# ---- RFM segments: (lowest score, label), best first ------------------------------------------
SEGMENTS = (
    (10, "🏆 Campeões (VIP)"),
    (8, "📈 Clientes Fiéis"),
    (6, "⚡ Potenciais"),
    (None, "💤 Em Risco/Perdidos"),
)
SEGMENT_LABELS = tuple(label for _, label in SEGMENTS)
BEGINNER = "Iniciante"
ALL_SEGMENTS = "Todos"
MIN_SCORED_CUSTOMERS = 10

# ---- text formats (Spark patterns) ------------------------------------------------------------
DATE_TEXT = "dd/MM/yyyy"
MINUTE_TEXT = "dd/MM/yyyy HH:mm"
MONTH_TEXT = "yyyy-MM"
DISPLAY_ZONE = "America/Sao_Paulo"
NEVER = "Nunca"

# ---- campaign messages; {shop} is the name of the business ------------------------------------
MESSAGES = {
    "Agradecimento": (
        "Olá {name}! 💜 Passando para agradecer por ser um dos nossos clientes {segment}. "
        "Sua preferência no {shop} é muito especial para nós!"
    ),
    "Saudades": (
        "Oi {name}! 🍦 Sentimos sua falta. Já faz {recency} dias que você não vem nos visitar. "
        "Que tal um açaí hoje para matar a saudade?"
    ),
    "Promoção": (
        "Fala {name}! 🎁 Como você é um cliente {segment}, liberamos um benefício exclusivo para "
        "você hoje na loja. Venha conferir!"
    ),
    "Feedback": (
        "Olá {name}! 🌟 Como foi sua última experiência? Sendo um cliente {segment}, sua opinião "
        "nos ajuda a ser cada vez melhores."
    ),
}
COUNTRY_PREFIX = "55"
CHAT_LINK = "https://wa.me/"

# ---- display headers --------------------------------------------------------------------------
FREQUENCY_HEADERS = {
    "name": "Cliente",
    "primeira_compra": "1ª Compra",
    "ultima_compra": "Última Compra",
    "num_compras": "Nº Compras",
    "total_gasto": "Total Gasto",
    "ticket_medio": "Ticket Médio",
    "media_frequencia_compra": "Freq Média (dias)",
    "max_dias_sem_recompra": "Máx Dias s/ Compra",
    "sales_channel": "Canal de Venda",
    "document_number": "CPF",
    "phone_number": "Telefone",
    "id": "Id",
}
TRANSACTION_HEADERS = {"id": "Id", "canal": "Canal", "data_venda": "Data Venda", "total": "Total"}
HISTORY_HEADERS = {"timestamp": "Data/Hora", "message_type": "Tipo", "message_body": "Mensagem"}
QUEUE_HEADERS = {
    "name": "Cliente",
    "phone_number": "Telefone",
    "sales_channel": "Canais",
    "segmento": "Tipo",
    "frequency": "Qtd Compras",
    "first_purchase": "Data 1ª Compra",
    "last_purchase": "Data Ult. Compra",
    "ultimo_contato": "Último Contato",
}
LISTING_HEADERS = {"sales_channel": "Canais"}
SEGMENT_COUNT_HEADERS = {"segmento": "Segmento", "quantidade": "Quantidade"}
